"""Secret scans: three patterns, and sliding-window entropy over candidate strings.

DataFrame functions only. Places of matches come from splitting the text at the pattern:
the lengths of what stands between the matches, and of the matches, add up to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, and the least length of what each must match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

#: Candidate strings of the entropy scan, its window, and bits a character by class of
#: characters: hex digits, letters and digits, with further signs, no digit. Windows of 20
#: random letters have about 3.7 bits (one case) or 4.0 (both), so 3.5 finds most; words
#: get there too, so candidates with a third of vowels or more (words), as few random ones
#: have, need 3.9.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8, "letters": 3.5, "words": 3.9}
#: Candidates that say themselves that they are no secrets.
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(?:api|secret|token|key|password)|x{6,}|0123456789|abcdefghij"

SPAN = "array<struct<kind:string,start:int,stop:int>>"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(df: DataFrame, name: str, values: str, start: str, merge: str) -> DataFrame:
    """df with `name`: for each item of the array `values` (a column, dropped) what `merge` (of s
    and y) makes of `start` and the items before it. Blocks of the square root of the
    length keep this from copying or adding up the whole array for each item."""
    fold = lambda part, first: f"aggregate({part}, {first}, (s, y) -> {merge})"
    df = df.withColumn("_step", F.expr(f"greatest(1, cast(ceil(sqrt(size({values}))) as int))"))
    blocks = f"""aggregate(sequence(0, (size({values}) - 1) div _step), named_struct('at', {start}, 'out', array({start})),
        (acc, b) -> named_struct('at', {fold(f"slice({values}, b * _step + 1, _step)", "acc.at")},
                                 'out', array_append(acc.out, {fold(f"slice({values}, b * _step + 1, _step)", "acc.at")})), acc -> acc.out)"""
    df = df.withColumn("_blocks", F.expr(f"if(size({values}) = 0, array({start}), {blocks})"))
    item = fold(f"slice({values}, (i div _step) * _step + 1, i % _step)", "_blocks[i div _step]")
    return df.withColumn(name, F.expr(f"transform({values}, (x, i) -> {item})")).drop(values, "_step", "_blocks")


def matches(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """df with columns `{name}_found` (the matches) and `{name}_start` (their first code
    points), for leftmost matches that don't overlap."""
    re = _sql(pattern)
    df = df.withColumn(f"{name}_found", F.expr(f"regexp_extract_all(text, {re}, 0)"))
    # only texts with a match are split
    df = df.withColumn(f"{name}_gaps", F.expr(f"if(size({name}_found) = 0, cast(array() as array<string>), split(text, {re}, -1))"))
    df = df.withColumn("_sizes", F.expr(f"transform({name}_found, (m, i) -> char_length({name}_gaps[i]) + char_length(m))"))
    df = running(df, f"{name}_start", "_sizes", "0", "s + y")
    return df.withColumn(f"{name}_start", F.expr(f"transform({name}_start, (x, i) -> x + char_length({name}_gaps[i]))")).drop(f"{name}_gaps")


def spans_of(name: str, kind: str, keep: str) -> Column:
    """Spans of the matches for which `keep` holds (of x.found, and x.value for assign)."""
    value = f"regexp_extract({name}_found[i], {_sql(ASSIGN)}, 2)" if name == "assign" else f"{name}_found[i]"
    return F.expr(
        f"""filter(transform(if(size({name}_found) = 0, cast(array() as array<int>), sequence(0, size({name}_found) - 1)),
        i -> if(char_length({value}) >= {keep}, named_struct('kind', '{kind}', 'start', {name}_start[i], 'stop', {name}_start[i] + char_length({name}_found[i])), null)), x -> x is not null)"""
    ).cast(SPAN)


def entropy_spans(df: DataFrame) -> DataFrame:
    """df with `entropy`: for each candidate string, from the first to the last window
    whose Shannon entropy reaches its class's threshold; allowed strings have none.

    Sliding the window by one changes two counts and, with them, two terms of the sum of
    c log2 c, from which the entropy follows: log2(window) - sum / window.
    """
    w = WINDOW
    df = matches(df, "cand", CANDIDATE)
    df = df.withColumn(
        "cand",
        F.expr(
            f"""filter(transform(if(size(cand_found) = 0, cast(array() as array<int>), sequence(0, size(cand_found) - 1)),
            i -> named_struct('s', cand_found[i], 'start', cand_start[i],
              'bits', case when cand_found[i] rlike {_sql(ALLOWED)} then null
                           when not cand_found[i] rlike '[0-9]' then
                             if(3 * char_length(regexp_replace(cand_found[i], '[^AEIOUaeiou]', '')) >= char_length(regexp_replace(cand_found[i], '[^A-Za-z]', '')), cast({BITS["words"]} as double), cast({BITS["letters"]} as double))
                           when cand_found[i] rlike '^([0-9a-f]+|[0-9A-F]+)$' then cast({BITS["hex"]} as double)
                           when cand_found[i] rlike '^[A-Za-z0-9]+$' then cast({BITS["alnum"]} as double)
                           else cast({BITS["base64"]} as double) end,
              'codes', transform(split(cand_found[i], ''), c -> ascii(c)))), x -> x.bits is not null)"""
        ),
    ).drop("cand_found", "cand_start")
    term = lambda x: f"if({x} <= 1, 0D, {x} * log2({x}))"
    into = "coalesce(try_element_at(x.codes, i), -1)"
    out = f"if(i > {w}, x.codes[i - {w} - 1], -1)"
    more, less = f"coalesce(acc.counts[{into}], 0)", f"coalesce(acc.counts[{out}], 0)"
    high = f"i > {w} and {_log2(w)} - acc.total / {w} >= x.bits - 1e-9"  # the window that ended before i
    walked = f"""aggregate(sequence(1, size(x.codes) + 1),
        named_struct('counts', array_repeat(0, 128), 'total', 0D, 'first', 0, 'last', 0),
        (acc, i) -> named_struct(
            'counts', transform(acc.counts, (c, k) -> c + if(k = {into}, 1, 0) - if(k = {out}, 1, 0)),
            'total', acc.total + if({into} = {out} or {into} < 0, 0D, {term(f"({more} + 1)")} - {term(more)} + if({out} < 0, 0D, {term(f"({less} - 1)")} - {term(less)})),
            'first', if(acc.first = 0 and {high}, i - 1, acc.first),
            'last', if({high}, i - 1, acc.last)),
        acc -> if(acc.last = 0, null, named_struct('kind', 'entropy', 'start', x.start + acc.first - {w}, 'stop', x.start + acc.last)))"""
    return df.withColumn("entropy", F.expr(f"filter(transform(cand, x -> {walked}), s -> s is not null)").cast(SPAN)).drop("cand")


def _log2(x: int) -> str:
    import math

    return f"cast({math.log2(x)!r} as double)"


def joined(spans: str) -> Column:
    """kind:start:end of the spans, by start and then by kind in the listed order."""
    order = "case x.kind when 'assign' then 0 when 'access' then 1 when 'hex' then 2 else 3 end"
    return F.expr(
        f"""array_join(transform(array_sort(transform({spans}, x -> named_struct('start', x.start, 'order', {order}, 'stop', x.stop, 'kind', x.kind))),
        x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"""
    )


def scan(docs: DataFrame) -> DataFrame:
    """docs with `base` and `spans`: arrays of (kind, start, stop) in code points, stop
    exclusive; base holds the kinds assign, access and hex, spans the kind entropy too.
    Columns of these names are replaced, others stay. A null or empty text has none;
    each row is scanned by itself and whole, so repeated rows fare alike and long texts
    are read to their end; no rows give none."""
    rest = [c for c in docs.columns if c not in ("base", "spans", "text")]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col("text").alias("given"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        df = matches(df, name, pattern)
    df = df.withColumn("base", F.concat(spans_of("assign", "assign", str(ASSIGN_VALUE)), spans_of("access", "access", str(ACCESS_LENGTH)), spans_of("hex", "hex", "32")))
    df = entropy_spans(df.drop("assign_found", "assign_start", "access_found", "access_start", "hex_found", "hex_start"))
    return df.select("rest.*", F.col("given").alias("text"), "base", F.concat("base", "entropy").alias("spans")) if rest else df.select(F.col("given").alias("text"), "base", F.concat("base", "entropy").alias("spans"))


def mask(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replaces what the spans cover (overlapping ones together) by `mark` in the text.
    Texts without spans, and null ones, stay as they are."""
    rest = [c for c in scanned.columns if c != "text"]
    df = scanned.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"), "text", "spans")
    df = df.withColumn("_spans", F.expr("array_sort(transform(spans, x -> named_struct('start', x.start, 'stop', x.stop)))"))
    # what is masked before each span reaches so far
    df = running(df.withColumn("_stops", F.expr("transform(_spans, x -> x.stop)")), "_reach", "_stops", "0", "greatest(s, y)")
    pieces = f"""concat(array_join(transform(_spans, (x, i) -> if(i > 0 and x.start < _reach[i], '',
            concat(substring(text, _reach[i] + 1, x.start - _reach[i]), {_sql(mark)}))), ''),
        substring(text, array_max(transform(_spans, x -> x.stop)) + 1))"""
    masked = F.expr(f"if(size(_spans) = 0, text, {pieces})").alias("text")
    return df.select(*[masked if c == "text" else F.col(f"_rest.`{c}`") for c in scanned.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans, for every row."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
