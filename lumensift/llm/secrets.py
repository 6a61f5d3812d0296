"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

All of it is Spark SQL expressions on one row: no shuffle, no Python. Offsets of matches come from the lengths of what
a pattern splits off and of what it matches, by prefix sums. The entropy of a window of ``W`` characters is
``log2 W - S / W`` with ``S`` the sum of ``c log2 c`` over the counts ``c`` of its characters; a step of the window
changes two counts, so ``S`` is updated and not summed again.

Defined results: null and empty texts have no spans; repeated rows are scanned each; positions count code points, ends
are exclusive; texts of any length are scanned whole; an empty table gives an empty result; further columns are not read. An entropy span that overlaps a pattern's span isn't added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length; in the order in which kinds sort.
PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
]
#: Kind, characters of the class, least entropy in bits of some window, what a candidate must hold besides.
CLASSES = [
    ("entropy_hex", r"[0-9A-Fa-f]", 2.9, r"^(?=.*[0-9])(?=.*[A-Fa-f])"),
    ("entropy_base64", r"[A-Za-z0-9+/_=-]", 3.7, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
    ("entropy_base36", r"[A-Za-z0-9+/_=-]", 3.5, r"^(?=.*[0-9])(?=.*[a-z])[^A-Z]*$"),
    ("entropy_base32", r"[A-Za-z0-9+/_=-]", 3.5, r"^(?=.*[0-9])(?=.*[A-Z])[^a-z]*$"),
]
WINDOW = 20
#: Candidates that hold one of these are no secrets.
ALLOWED = [
    r"(?i)example|placeholder|changeme|dummy|sample|your[_-]?(key|token|secret)",
    r"(?i)0123456789|abcdefghij|12345678901",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(.)\1{7}",
]


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _prefix_sums(array: str) -> str:
    """SQL for the inclusive running sums of a non-empty array<bigint>: in blocks, so that it takes n^1.5 steps, not n^2."""
    block = f"cast(ceil(sqrt(size({array}))) as int)"
    sums = "aggregate({0}, array(cast(0 as bigint)), (acc, x) -> array_append(acc, element_at(acc, -1) + x))"
    blocks = f"transform(sequence(0, (size({array}) - 1) div {block}), k -> slice({array}, k * {block} + 1, {block}))"
    inner = f"transform({blocks}, b -> slice({sums.format('b')}, 2, size(b)))"
    offsets = sums.format(f"transform({blocks}, b -> aggregate(b, cast(0 as bigint), (acc, x) -> acc + x))")
    return f"flatten(zip_with({inner}, slice({offsets}, 1, size({blocks})), (b, o) -> transform(b, x -> x + o)))"


def _located(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds _m_<name>: the matches; _p_<name>: the offset of each."""
    rx = _literal(pattern)
    df = df.withColumn(f"_m_{name}", F.expr(f"if(_any, regexp_extract_all(_text, {rx}, 0), cast(array() as array<string>))"))
    df = df.withColumn(f"_s_{name}", F.expr(f"if(size(_m_{name}) > 0, split(_text, {rx}, -1), cast(array() as array<string>))"))
    steps = f"transform(_m_{name}, (m, i) -> cast(length(_s_{name}[i]) + if(i > 0, length(_m_{name}[i - 1]), 0) as bigint))"
    df = df.withColumn(f"_d_{name}", F.expr(steps))
    return df.withColumn(f"_p_{name}", F.expr(f"if(size(_d_{name}) > 0, {_prefix_sums(f'_d_{name}')}, cast(array() as array<bigint>))")).drop(f"_s_{name}", f"_d_{name}")


def _entropy(text: str) -> str:
    """SQL for the greatest entropy of a window of the string, by incremental counts of its distinct characters."""
    f = "if({0} > 1, {0} * log2({0}), 0D)"
    codes = f"transform(split({text}, ''), c -> cast(array_position(chars, c) - 1 as int))"
    old, gone = "acc.n[codes[i]]", "acc.n[codes[i - %d]]" % WINDOW
    # the character that leaves goes first; its count is read before, the entering one's after that
    leave = f"if(i < {WINDOW}, acc.s, acc.s + {f.format(f'({gone} - 1)')} - {f.format(gone)})"
    entering = f"({old} - if(i >= {WINDOW} and codes[i] = codes[i - {WINDOW}], 1, 0))"
    s = f"{leave} + {f.format(f'({entering} + 1)')} - {f.format(entering)}"
    counts = f"transform(acc.n, (c, k) -> c + if(k = codes[i], 1, 0) - if(i >= {WINDOW}, if(k = codes[i - {WINDOW}], 1, 0), 0))"
    step = f"named_struct('n', {counts}, 's', {s}, 'low', if(i >= {WINDOW} - 1, least(acc.low, {s}), acc.low))"
    start = "named_struct('n', array_repeat(0, size(chars)), 's', 0D, 'low', double('infinity'))"
    fold = f"aggregate(sequence(0, size(codes) - 1), {start}, (acc, i) -> {step}, acc -> log2({WINDOW}) - acc.low / {WINDOW})"
    numbered = f"element_at(transform(array({codes}), codes -> {fold}), 1)"
    return f"element_at(transform(array(array_distinct(split({text}, ''))), chars -> {numbered}), 1)"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: list[str] = ALLOWED) -> DataFrame:
    """(doc_id, spans): array of (start, rank, kind, end, value), by start, then kind in listed order."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    cheap = "|".join([r"(?i:passw|secret|token|api_?key)", r"AKIA[A-Z0-9]", r"[0-9a-f]{24}", r"[A-Za-z0-9+/_=-]{%d}" % WINDOW])
    df = df.withColumn("_any", F.col("_text").rlike(cheap))
    groups = []
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        df = _located(df, kind, pattern)
        value = f"regexp_extract(m, {_literal(pattern)}, {group})"
        span = f"named_struct('start', _p_{kind}[i], 'rank', {rank}, 'kind', '{kind}', 'end', _p_{kind}[i] + length(m), 'value', m)"
        df = df.withColumn(f"_b_{kind}", F.expr(f"filter(transform(_m_{kind}, (m, i) -> if(length({value}) >= {least}, {span}, null)), x -> x is not null)")).drop(f"_m_{kind}", f"_p_{kind}")
        groups.append(f"_b_{kind}")
    df = df.withColumn("_base", F.concat(*groups))
    added = []
    for n, (kind, chars, least, must) in enumerate(CLASSES):
        rank = len(PATTERNS) + n
        df = _located(df, kind, f"{chars}{{{WINDOW},}}")
        fits = f"m rlike {_literal(must)}" + "".join(f" and not (m rlike {_literal(a)})" for a in allowed)
        own = f"not exists(_base, b -> b.start < _p_{kind}[i] + length(m) and b.end > _p_{kind}[i])"
        span = f"named_struct('start', _p_{kind}[i], 'rank', {rank}, 'kind', '{kind}', 'end', _p_{kind}[i] + length(m), 'value', m)"
        hit = f"if({fits} and {own}, if({_entropy('m')} >= {least}, {span}, null), null)"
        df = df.withColumn(f"_b_{kind}", F.expr(f"filter(transform(_m_{kind}, (m, i) -> {hit}), x -> x is not null)")).drop(f"_m_{kind}", f"_p_{kind}")
        added.append(f"_b_{kind}")
    return df.select("doc_id", F.array_sort(F.concat("_base", *added)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
