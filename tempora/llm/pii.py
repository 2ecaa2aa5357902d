"""Personal data: exact base patterns, and contextual extraction bootstrapped from what they find.

Base spans are the leftmost non-overlapping matches of four patterns, with their digit and
checksum tests. They seed a graph of instances and contexts. A base span is an instance known to be
of its kind; unknown instances are the runs of tokens that hold digits or an at sign, and those of
their single tokens and sub-runs of up to SUB_RUN tokens that have the shape of a kind, so that no
identifier is lost for what stands beside it. The contexts of an instance are the words before and
after it. In each round Spark
scores every context by its distinct instances of one kind against those that cannot be of it: known
as another kind, or unknown and not of the kind's shape. Unknown ones of the shape count for neither,
as they may be what is looked for. It trusts contexts of at least MIN_SUPPORT and MIN_CONFIDENCE, and
takes in unknown candidates of the kind's shape whose trusted contexts together leave less than
1 - ACCEPT doubt. What was taken in counts in the next round; rounds go on until nothing is. Spans
of what was taken in are added, the first and longest where two of them meet.

All of it is SQL expressions, put together as text, since building them call by call costs seconds
of driver time. A text is searched once per pattern, cut at its matches, and
positions come from the lengths of the parts, summed in blocks of blocks; patterns are possessive, so
Java's matcher neither recurses nor goes over a long token more than once. Replaced texts are put
together from parts in one step. So the work on a text is near linear in its length and its spans.
Positions are code points, end exclusive.

Null text: empty, no spans. Very long texts are searched whole. Repeated rows get the same spans
each. Ties: a candidate of two kinds takes the one of greater score, then the later name. Empty
table: no rows. Extra columns, whatever their names, are not read, and pass through redact() untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from tempora.llm.common import documents, materialize, whole

KINDS = ("email", "ip", "card", "phone")
#: The base patterns; possessive, and starting at a run's first character or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Whether a text can hold the kind at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: The shape of a candidate that may be taken in as the kind.
SHAPES = {
    "email": r"^\S{1,40}@\S{3,40}$",
    "ip": r"^[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}$",
    "card": r"^[0-9](?:[ .-]?[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,14}$",
}
#: Tokens of a sub-run at most; the shapes of no kind have more groups.
SUB_RUN = 6
MIN_SUPPORT = 8
MIN_CONFIDENCE = 0.95
ACCEPT = 0.97
#: Numbers that are summed one by one, and characters of a part of a text.
BLOCK, PART = 64, 512
#: Characters above which an instance or a context stands under its hash; no shape allows so many.
NAME = 96

# Noncharacters of Unicode that mark the kinds of base spans and the cuts in a copy of the text.
MASKS = dict(zip(KINDS, "﷐﷑﷒﷓"))
CUT = "﷔"
_MASK = "﷐-﷓"
_TOKEN = rf"[^\s0-9@{_MASK}]*+[0-9@][^\s{_MASK}]*+(?!\S)"
CANDIDATE = "|".join(f"{m}++" for m in MASKS.values()) + rf"|(?<!\S){_TOKEN}(?: {_TOKEN})*+"
_ANY_SHAPE = "|".join(f"(?:{s})" for s in SHAPES.values())
# The word before and after an instance, past punctuation that opens or closes; an instance's own, and a name that stands before it. \x22 and \x27 are quotes.
_BEFORE, _AFTER = r"(?<!\S)(\S++)\s*+[\x22\x27<(\[]*+$", r"^[.,;:!?>\x22\x27)\]]*+\s*+(\S++)"
_HEAD, _CORE = r"^[\x22\x27<\[]*+", r"^[\x22\x27<\[]*+(.*?)[.,;:!?>\x22\x27\]]*+$"
_KEY = r"^([A-Za-z_-]{1,32}+[:=])(?=\S)"

SPAN = "array<struct<kind:string,s:int,e:int>>"
MATCH = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
FOUND = "array<struct<s:int,e:int,inst:string,l:string,r:string,known:string>>"
_names = (f"v{i}" for i in count())


# ---- expressions as SQL text
# Spark's parser keeps a state for each token that it must look past to tell what it reads, and holds all of them for good.
# It reads if(), expression::type and calls at once, but looks through all of a CASE, a CAST or what stands in brackets first.

def lit(x: str) -> str:
    """A raw string literal; patterns name quotes by their codes."""
    return "r'" + x.replace("'", r"\x27") + "'"


def none(kind: str) -> str:
    return f"cast(array() as {kind})"


def _choice(of: list[tuple[str, str]]) -> str:
    """The word of the first condition that holds, or null."""
    return "".join(f"if({c}, '{word}', " for c, word in of) + "null" + ")" * len(of)


def let(x: str, body: Callable[[str], str]) -> str:
    """body of x, with x evaluated once."""
    return f"element_at({each(f'array({x})', body)}, 1)"


def each(a: str, f: Callable[[str], str], fn: str = "transform") -> str:
    v = next(_names)
    return f"{fn}({a}, {v} -> {f(v)})"


def placed(a: str, f: Callable[[str, str], str], fn: str = "transform") -> str:
    v, i = next(_names), next(_names)
    return f"{fn}({a}, ({v}, {i}) -> {f(v, i)})"


def _sum(a: str) -> str:
    return f"aggregate({a}, 0, (x, y) -> x + y)"


def _most(a: str) -> str:
    return f"coalesce(array_max({a}), 0)"


def _div(i: str, n: int) -> str:
    return f"int(({i}) div {n})"


def _blocks(n: str, fold: Callable[[str], str]) -> str:
    return each(f"sequence(0, {_div(f'size({n})', BLOCK)})", lambda b: fold(f"slice({n}, {b} * {BLOCK} + 1, {BLOCK})"))


def running(n: str, fold: Callable, join: Callable, body: Callable[[Callable], str]) -> str:
    """body, given a function for the fold of the first i of the numbers n; two levels of blocks keep that short."""
    def start(levels: str, i: str) -> str:
        return let(i, lambda k: join(f"get({levels}, {_div(k, BLOCK)})", fold(f"slice({n}, {_div(k, BLOCK)} * {BLOCK} + 1, {k} % {BLOCK})")))

    def upper(one: str) -> str:
        def before(two: str) -> str:
            return each(f"sequence(0, size({one}) - 1)", lambda b: join(fold(f"slice({two}, 1, {_div(b, BLOCK)})"), fold(f"slice({one}, {_div(b, BLOCK)} * {BLOCK} + 1, {b} % {BLOCK})")))

        return let(let(_blocks(one, fold), before), lambda levels: body(lambda i: start(levels, i)))

    return let(_blocks(n, fold), upper)


def summed(n: str, body: Callable[[Callable], str]) -> str:
    return running(n, _sum, lambda a, b: f"{a} + {b}", body)


def furthest(spans: str, body: Callable[[Callable], str]) -> str:
    """body, given a function for where the first i of spans end."""
    return let(each(spans, lambda x: f"{x}.e"), lambda ends: running(ends, _most, lambda a, b: f"greatest({a}, {b})", body))


def matches(text: str, pattern: str, contexts: bool = False) -> str:
    """All matches in text, as MATCH; with contexts, also the parts before and after each. text must not hold CUT."""
    def located(p: str) -> str:
        def at(start: Callable) -> str:
            def one(k: str) -> str:
                i = f"2 * {k} + 1"
                around = (f"get({p}, 2 * {k})", f"get({p}, 2 * {k} + 2)") if contexts else ("null", "null")
                return let(start(i), lambda s: f"named_struct('s', {s}, 'e', {s} + char_length(get({p}, {i})), 'm', get({p}, {i}), 'before', {around[0]}, 'after', {around[1]})")

            return each(f"sequence(0, {_div(f'size({p}) - 3', 2)})", one)

        found = let(each(p, lambda x: f"char_length({x})"), lambda n: summed(n, at))
        return f"if(size({p}) > 1, {found}::{MATCH}, {none(MATCH)})"

    return let(f"split(regexp_replace({text}, {lit(pattern)}, '{CUT}$0{CUT}'), '{CUT}', -1)", located)


def searchable(text: str) -> str:
    """text with the noncharacters that serve as marks here replaced, one for one."""
    marks = "".join(MASKS.values()) + CUT
    return f"if(octet_length({text}) > char_length({text}) and {text} rlike '[{marks}]', translate({text}, '{marks}', '{chr(0xFFFD) * len(marks)}'), {text})"


def parts_of(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{PART}}}', 0)"


def cut(parts: str, a: str, b: str | None = None) -> str:
    """The text of parts from a to b, or to its end; looks only at the parts that it needs."""
    part = lambda i: f"coalesce(get({parts}, {i}), '')"
    i = _div(a, PART)
    rest = f"substring({part(i)}, {a} % {PART} + 1, {PART})"
    if b is None:
        return f"concat({rest}, array_join(slice({parts}, {i} + 2, size({parts})), ''))"
    j = _div(b, PART)
    far = f"concat({rest}, array_join(slice({parts}, {i} + 2, greatest({j} - {i} - 1, 0)), ''), substring({part(j)}, 1, {b} % {PART}))"
    return f"if({i} = {j}, substring({part(i)}, {a} % {PART} + 1, {b} - {a}), {far})"


def replaced(text: str, spans: str, new: Callable[[str, str], str]) -> str:
    """text with what spans (by start, the longest first) cover replaced by new(span, where what stood before it ends)."""
    def build(parts: str) -> str:
        def put(reach: Callable) -> str:
            piece = lambda x, i: let(reach(i), lambda m: f"concat({let(f'greatest({m}, {x}.s)', lambda t: cut(parts, m, t))}, {new(x, m)})")
            return f"concat(array_join({placed(spans, piece)}, ''), {let(reach(f'size({spans})'), lambda m: cut(parts, m))})"

        return furthest(spans, put)

    return f"if(size({spans}) = 0, {text}, {let(parts_of(text), build)})"


def by_start(spans: str) -> str:
    turned = each(spans, lambda x: f"named_struct('s', {x}.s, 'n', -{x}.e, 'kind', {x}.kind)")
    return f"{each(f'array_sort({turned})', lambda x: f'''named_struct('kind', {x}.kind, 's', {x}.s, 'e', -{x}.n)''')}::{SPAN}"


def apart(spans: str) -> str:
    """Those of spans (by start, the longest first) that start where all before them have ended."""
    kept = furthest(spans, lambda reach: placed(spans, lambda x, i: f"{x}.s >= {reach(i)}", "filter"))
    return f"if(size({spans}) < 2, {spans}, {kept})"


# ---- base spans

def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def valid(kind: str, m: str) -> str:
    if kind == "ip":
        small = lambda p: let(f"regexp_replace({p}, '^0++', '')", lambda q: f"char_length({q}) <= 3 and coalesce(try_cast({q} as int), 0) <= 255")
        return each(f"split({m}, '[.]')", small, "forall")
    if kind == "card":
        return let(_digits(m), lambda d: f"char_length({d}) between 13 and 19 and luhn_check({d})")
    if kind == "phone":
        return f"char_length({_digits(m)}) between 9 and 15"
    return "true"


def base_spans(text: str) -> str:
    """All base spans of a searchable text, by kind and start."""
    per = []
    for kind in KINDS:
        some = each(matches(text, PATTERNS[kind]), lambda x: valid(kind, f"{x}.m"), "filter")
        spans = each(some, lambda x: f"named_struct('kind', '{kind}', 's', {x}.s, 'e', {x}.e)")
        may = f"contains({text}, '{NEEDS[kind]}')" if NEEDS[kind] else f"{text} rlike '[0-9]'"
        per.append(f"if({may}, {spans}::{SPAN}, {none(SPAN)})")
    return f"concat({', '.join(per)})"


# ---- instances and contexts

def masked(text: str, base: str) -> str:
    """text with each character of a base span replaced by the mark of its kind."""
    def mark(x: str, m: str) -> str:
        sign = _choice([(f"{x}.kind = '{k}'", s) for k, s in MASKS.items()])
        return f"repeat({sign}, greatest({x}.e - greatest({m}, {x}.s), 0))"

    return f"if(size({base}) = 0, {text}, {let(by_start(base), lambda spans: replaced(text, spans, mark))})"


def _name(x: str) -> str:
    return f"if(char_length({x}) > {NAME}, concat('#', cast(xxhash64({x}) as string)), lower({x}))"


def _last_word(part: str) -> str:
    word = lambda t: f"regexp_extract({t}, {lit(_BEFORE)}, 1)"
    near = let(word(f"substring({part}, {-2 * NAME}, {2 * NAME})"), lambda w: f"if(char_length({w}) < {NAME}, {w}, {word(part)})")
    return f"if({part} = '', '', {near})"


def _first_word(part: str) -> str:
    return f"regexp_extract({part}, {lit(_AFTER)}, 1)"


def _instance(s: str, m: str, left: str, right: str) -> str:
    """An unknown instance without outer punctuation; a name and a colon or equals sign before it count as the word on its left."""
    def named(g: str) -> str:
        head, core = f"char_length(get({g}, 0))", f"get({g}, 1)"
        return let(f"regexp_extract({core}, {lit(_KEY)}, 1)", lambda k: f"""named_struct('s', {s} + {head} + char_length({k}), 'e', {s} + {head} + char_length({core}),
            'inst', {let(f'substring({core}, char_length({k}) + 1, char_length({core}))', _name)},
            'l', if({k} <> '', lower({k}), {let(left, _name)}), 'r', {let(right, _name)}, 'known', cast(null as string))""")

    return let(f"array(regexp_extract({m}, {lit(_HEAD)}, 0), regexp_extract({m}, {lit(_CORE)}, 1))", named)


def _parts_of_run(x: str) -> str:
    """A run of tokens as instances: as a whole, and its sub-runs that have a shape."""
    whole_run = f"array({_instance(f'{x}.s', f'{x}.m', _last_word(f'{x}.before'), _first_word(f'{x}.after'))})"

    def split(words: str) -> str:
        last = f"(size({words}) - 1)"

        def of(start: Callable) -> str:
            def sub(i: str, j: str) -> str:
                left = f"if({i} > 0, get({words}, {i} - 1), {_last_word(f'{x}.before')})"
                right = f"if({j} < {last}, get({words}, {j} + 1), {_first_word(f'{x}.after')})"
                return let(f"array_join(slice({words}, {i} + 1, {j} - {i} + 1), ' ')", lambda m: _instance(f"{x}.s + {start(i)}", m, left, right))

            ends = lambda i: each(f"sequence({i}, least({i} + {SUB_RUN - 1}, {last}))", lambda j: f"{j} - {i} < {last}", "filter")
            subs = each(f"sequence(0, {last})", lambda i: each(ends(i), lambda j: sub(i, j)))
            return f"concat({whole_run}, {each(f'flatten({subs})', lambda c: f'{c}.inst rlike {lit(_ANY_SHAPE)}', 'filter')})"

        return summed(each(words, lambda w: f"char_length({w}) + 1"), of)

    return f"if(contains({x}.m, ' '), {let(f'''split({x}.m, ' ')''', split)}::{FOUND}, {whole_run}::{FOUND})"


def candidates(text: str, base: str) -> str:
    """Known and unknown instances of a searchable text with the words around them, as FOUND."""
    def known(x: str, parts: str) -> str:
        kind = _choice([(f"startswith({x}.m, '{s}')", k) for k, s in MASKS.items()])
        seen = lambda k: f"""named_struct('s', {x}.s, 'e', {x}.e, 'inst', {let(cut(parts, f'{x}.s', f'{x}.e'), _name)}, 'l', {let(_last_word(f'{x}.before'), _name)}, 'r', {let(_first_word(f'{x}.after'), _name)}, 'known', {k})"""
        return let(kind, lambda k: f"if({k} is not null, array({seen(k)})::{FOUND}, {_parts_of_run(x)})")

    found = lambda parts: each(f"flatten({each(matches(masked(text, base), CANDIDATE, True), lambda x: known(x, parts))})", lambda c: f"{c}.inst <> ''", "filter")
    parts = f"if(size({base}) > 0, {parts_of(text)}, {none('array<string>')})"
    return f"if({text} rlike '[0-9@]', {let(parts, found)}, {none(FOUND)})"


def scan(docs: DataFrame, *keep: Column) -> DataFrame:
    """The one pass over the texts, written to the shared folder: id, hash of the text, base spans, instances, and the columns keep."""
    rows = docs.select(*keep, "doc_id", F.expr("xxhash64(coalesce(text, ''))").alias("th"), F.expr(searchable("coalesce(text, '')")).alias("_s"))
    rows = rows.withColumn("base", F.expr(base_spans("_s"))).withColumn("found", F.expr(candidates("_s", "base")))
    return materialize(rows.drop("_s"), "pii-scan")


def discover(scanned: DataFrame) -> DataFrame | None:
    """Spans beyond the base ones, as doc_id, th, kind, s, e; None if no context came to be trusted."""
    c = scanned.select("doc_id", "th", F.explode("found").alias("c")).select("doc_id", "th", "c.*")
    context = F.array(F.concat(F.lit("l:"), "l"), F.concat(F.lit("r:"), "r"))
    edges = c.select("inst", F.explode(context).alias("context")).where(F.char_length("context") > 2).distinct()
    edges = materialize(edges, "pii-graph")
    seeds = c.where(F.col("known").isNotNull()).groupBy("inst").agg(F.min("known").alias("kind")).withColumn("score", F.lit(1.0))
    seeds = materialize(seeds, "pii-seeds")
    shape, others = F.lit(False), F.lit(None)
    for kind in KINDS:
        shape = shape | ((F.col("kind") == kind) & F.col("inst").rlike(SHAPES[kind]))
        others = F.when(F.col("kind") == kind, F.col(f"not_{kind}")).otherwise(others)
    against = [F.sum(F.coalesce(F.col("kind") != kind, ~F.col("inst").rlike(SHAPES[kind])).cast("int")).alias(f"not_{kind}") for kind in KINDS]
    size = edges.join(seeds, "inst", "left").groupBy("context").agg(F.count("*").alias("n"), *against).where(F.col("n") >= MIN_SUPPORT)
    size = materialize(size, "pii-contexts")
    scores, taken = seeds, None
    while True:
        trusted = edges.join(scores, "inst").groupBy("context", "kind").agg(F.sum("score").alias("hit"))
        trusted = trusted.where(F.col("hit") >= MIN_SUPPORT).join(size, "context").withColumn("confidence", F.col("hit") / (F.col("hit") + others)).where(F.col("confidence") >= MIN_CONFIDENCE)
        doubt = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))
        fresh = edges.join(trusted.select("context", "kind", "confidence"), "context").groupBy("inst", "kind").agg((1 - doubt).alias("score"))
        fresh = fresh.where(shape & (F.col("score") >= ACCEPT)).groupBy("inst").agg(F.max(F.struct("score", "kind")).alias("b")).select("inst", "b.kind", "b.score")
        fresh = materialize(fresh.join(scores.select("inst"), "inst", "left_anti"), "pii-taken")
        if fresh.isEmpty():
            break
        taken = fresh if taken is None else materialize(taken.unionByName(fresh), "pii-taken")
        scores = materialize(scores.unionByName(fresh), "pii-scores")
    if taken is None:
        return None
    return c.where(F.col("known").isNull()).join(taken.select("inst", "kind"), "inst").select("doc_id", "th", "kind", "s", "e").distinct()


def _with_added(rows: DataFrame, added: DataFrame | None) -> DataFrame:
    """rows (doc_id, th and more) with added, the array of discovered spans, none of which meet."""
    if added is None:
        return rows.withColumn("added", F.expr(none(SPAN)))
    spans = added.groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "s", "e")).alias("added")).withColumn("added", F.expr(by_start("added"))).withColumn("added", F.expr(apart("added")))
    spans = spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    on = rows["doc_id"].eqNullSafe(spans["_id"]) & (rows["th"] == spans["_th"])
    return rows.join(spans, on, "left").drop("_id", "_th").withColumn("added", F.expr(f"coalesce(added, {none(SPAN)})"))


def _listed(spans: str) -> Column:
    return F.expr(f"array_join({each(spans, lambda x: f'''concat_ws(':', {x}.kind, cast({x}.s as string), cast({x}.e as string))''')}, ',')")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, th, base and spans: base and discovered spans by kind, then start."""
    scanned = scan(docs)
    out = _with_added(scanned.drop("found"), discover(scanned))
    of_kind = lambda k: each("concat(base, added)", lambda x: f"{x}.kind = '{k}'", "filter")
    return out.withColumn("spans", F.expr(f"concat({', '.join(f'array_sort({of_kind(k)})' for k in KINDS)})")).drop("added")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    counts = [F.expr(f"bigint(size(filter(spans, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its texts replaced by its kind in angle brackets; n_chars follows the text. The texts are searched once and written beside what was found."""
    scanned = scan(docs, whole(docs))
    added = discover(scanned)
    rows = _with_added(scanned.select("doc", "doc_id", "th", "base"), added).withColumn("all", F.expr(by_start("concat(base, added)")))
    sign = lambda x, m: f"if({x}.s >= {m}, concat('<', upper({x}.kind), '>'), '')"
    rows = rows.withColumn("text", F.expr(f"if(doc.text is null or size(all) = 0, doc.text, {replaced('doc.text', 'all', sign)})"))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return rows.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
