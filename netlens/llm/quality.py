"""Quality rules: base limits, then robust multivariate outliers per language and source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import WORD_BREAK, materialise

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable is bound, not copied into each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeats(words: Column, size: int) -> Column:
    """Words that lie in a window of `size` words found twice or more in the same text, each counted once."""

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        fresh = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(size), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(_let(placed, positions), F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")), fresh, lambda acc: acc["n"])

    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - F.lit(size - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))
    counted = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n > size, counted).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column `q`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (all long).

    Windows are compared by 64-bit hashes of their words, inside the row: no text is exploded or shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("_netlens_words", F.filter(F.split(text, WORD_BREAK), lambda w: w != ""))
    words = F.col("_netlens_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    q = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _repeats(words, WINDOW).alias("n_repeat_words"),
        _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("lines"),
    )
    return rows.withColumn("q", q).drop("_netlens_words")


#: The statistic vector: mean word length, symbols per word, share of repeated words, share of repeated lines.
VECTOR = ["x0", "x1", "x2", "x3"]
#: Spread below which no difference counts, for each of them: a share that is zero in half of a group has no scatter of its own.
FLOORS = [0.08, 0.25, 0.09, 0.11]
#: Chi-square quantiles with four degrees of freedom: the median, and 1 - 1e-6.
MEDIAN_4, CUTOFF_4 = 3.3567, 33.3768
#: A group of fewer rows uses its language's estimate, a language of fewer rows that of all rows.
GROUP_ROWS = 60
#: Up to so many groups with an estimate are broadcast; more are joined by a shuffle, the rows of a group dealt over SALT parts.
BROADCAST_GROUPS = 4096
SALT = 32
STEPS = 3


def vector(q: str = "q") -> list[Column]:
    n = F.greatest(F.col(f"{q}.n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col(f"{q}.lines.all"), F.lit(1))
    return [F.log(F.greatest(F.col(f"{q}.word_chars") / n, F.lit(0.5))), F.log1p(20 * F.col(f"{q}.n_symbols") / n),
            F.col(f"{q}.n_repeat_words") / n, F.col(f"{q}.lines.dup") / lines]


def base_failed(q: str = "q") -> Column:
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{q}.n_words"))


def _levels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Which groups get an estimate: (k, level) for each whole key, its first part, and everything, by their rows."""
    counts = rows.groupBy(*keys).count()
    out = None
    for depth in range(len(keys), -1, -1):
        some = counts.groupBy(_key(keys, depth).alias("k")).agg(F.sum("count").alias("n")) if depth else counts.agg(F.sum("count").alias("n")).select(_key(keys, 0).alias("k"), "n")
        if depth:
            some = some.where(F.col("n") >= GROUP_ROWS)
        out = some if out is None else out.unionByName(some)
    return out.select("k")


def _key(keys: list[str], depth: int) -> Column:
    """A text for the first `depth` keys; null is a value of its own."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null")) for k in keys[:depth]]
    return F.concat_ws("\x1f", F.lit(str(depth)), *parts)


def _hint(table: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(table) if small else table


def _joined(rows: DataFrame, table: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """rows(g, x0..x3, ...) with the columns of table(k, ...), which has a row for each group."""
    if small:
        return rows.join(F.broadcast(table), F.col("g") == F.col("k"), how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = rows.withColumn("_salted", F.pmod(F.xxhash64(*VECTOR), F.lit(SALT)).cast("int"))
    return rows.join(salted, (F.col("g") == F.col("k")) & (F.col("_salted") == F.col("_salt")), how).drop("_salt", "_salted")


def _with_group(rows: DataFrame, groups: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """rows with g, the most specific key that has an estimate."""
    for depth in range(1, len(keys) + 1):
        rows = rows.join(_hint(groups.select(F.col("k").alias(f"_g{depth}"), F.lit(True).alias(f"_has{depth}")), small), _key(keys, depth) == F.col(f"_g{depth}"), "left")
    g = F.coalesce(*[F.when(F.col(f"_has{d}"), F.col(f"_g{d}")) for d in range(len(keys), 0, -1)], _key(keys, 0))
    return rows.withColumn("g", g).drop(*[f"_{x}{d}" for d in range(1, len(keys) + 1) for x in ("g", "has")])


def _estimated(rows: DataFrame, groups: DataFrame, params: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """rows with the estimate that judges them. Many groups are looked up for each distinct key first, so rows are dealt out once."""
    if small:
        return _joined(_with_group(rows, groups, keys, small), params, small, "left")
    known = _with_group(rows.select(*keys).distinct(), groups, keys, small).select(_key(keys, len(keys)).alias("_whole"), "g")
    known = known.join(params, F.col("g") == F.col("k"), "left").drop("k", "g").withColumnRenamed("_whole", "k")
    return _joined(rows.withColumn("g", _key(keys, len(keys))), known, small, "left")


def _whitened(params: DataFrame) -> DataFrame:
    """From the means m0.. and scatters s00.. to w (rows of the inverse Cholesky factor), column by column."""
    p = len(VECTOR)
    for j in range(p):
        d = F.col(f"s{j}{j}")
        for k in range(j):
            d = d - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        params = params.withColumn(f"l{j}{j}", F.sqrt(F.greatest(d, F.lit(1e-12))))
        for i in range(j + 1, p):
            c = F.col(f"s{j}{i}")
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", c / F.col(f"l{j}{j}"))
    for i in range(p):
        params = params.withColumn(f"w{i}{i}", 1 / F.col(f"l{i}{i}"))
        for j in range(i - 1, -1, -1):
            c = F.lit(0.0)
            for k in range(j, i):
                c = c + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            params = params.withColumn(f"w{i}{j}", -c / F.col(f"l{i}{i}"))
    return params.select("k", *[f"m{i}" for i in range(p)], *[f"w{i}{j}" for i in range(p) for j in range(i + 1)])


def _distance() -> Column:
    """Squared Mahalanobis distance of x to the mean m, w being the inverse Cholesky factor of the scatter."""
    out = F.lit(0.0)
    for i in range(len(VECTOR)):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        out = out + y * y
    return out


def fit(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Minimum covariance determinant for each g of rows(g, x0..x3): k, means, inverse Cholesky factors and cutoff.

    It starts from medians and median deviations; each concentration step takes the half of the group that is nearest to
    the last estimate and estimates anew, which never raises the determinant. FLOORS squared are added to the diagonal, so
    a group whose half has no scatter stays regular, and the scatter is scaled so that the median distance is that of
    normal data, up to a factor of four. All aggregates are partial sums or quantile sketches; a group of a third of all
    rows is folded where it lies.
    """
    p = range(len(VECTOR))
    small = _few(groups)
    centre = rows.groupBy("g").agg(*[F.percentile_approx(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in p])
    centre = centre.withColumnRenamed("g", "k")
    spread = _joined(rows, centre, small).groupBy("k", *[f"m{i}" for i in p]).agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), F.lit(0.5)).alias(f"d{i}") for i in p])
    params = spread.select("k", *[f"m{i}" for i in p], *[(F.pow(1.4826 * F.col(f"d{i}"), F.lit(2.0)) + F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i in p for j in range(i, len(VECTOR))])
    params = materialise(_whitened(params), "mcd")
    for _ in range(STEPS):
        near = _joined(rows, params, small).withColumn("d", _distance())
        half = materialise(near.groupBy("g").agg(F.percentile_approx("d", F.lit(0.5), F.lit(2000)).alias("half")).withColumnRenamed("g", "k"), "mcd")
        inner = _joined(near.drop("k"), half, small).where("d <= half")
        sums = inner.groupBy("k").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in p], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in p for j in range(i, len(VECTOR))])
        params = materialise(_whitened(sums.select("k", *[f"m{i}" for i in p], *[(F.col(f"c{i}{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i in p for j in range(i, len(VECTOR))])), "mcd")
    near = _joined(rows, params, small).withColumn("d", _distance())
    scale = near.groupBy("g").agg(F.percentile_approx("d", F.lit(0.5), F.lit(2000)).alias("half"))
    cutoff = F.lit(CUTOFF_4) * F.least(F.greatest(F.col("half") / F.lit(MEDIAN_4), F.lit(1.0)), F.lit(4.0))
    return params.join(_hint(scale.select(F.col("g").alias("k"), cutoff.alias("cutoff")), small), "k")


def _few(groups: DataFrame | None) -> bool:
    return groups is None or groups.count() <= BROADCAST_GROUPS


def judged(scored: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """scored (rows of statistics(), written) with base_failed, distance and kept.

    The estimates are made from rows that pass the base rules. A row whose group, language and whole table have no
    estimate (all failed) is judged by the base rules alone.
    """
    keys = list(keys)
    rows = scored.withColumns({"base_failed": base_failed()} | dict(zip(VECTOR, vector(), strict=True)))
    fitted = rows.where("not base_failed").select(*keys, *VECTOR)
    groups = materialise(_levels(fitted, keys), "groups")
    # a row counts for its own group, for its language and for the whole, so that each level is estimated from all of its rows
    levels = F.explode(F.array(*[_key(keys, d) for d in range(len(keys) + 1)]))
    small = _few(groups)
    each = _joined(fitted.select(levels.alias("g"), *VECTOR), groups, small).drop("k")
    params = materialise(fit(each, groups), "mcd")
    placed = _estimated(rows, groups, params, keys, small).withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True))
    return placed.withColumn("kept", kept)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    A null or blank text has no words and fails the base rules; null keys form a group of their own; repeated rows are
    judged once each; an empty table gives no rows. Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(k).cast("string").alias(k) for k in keys])
    scored = materialise(statistics(base).drop("text"), "quality")
    return judged(scored, keys).select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", F.col("q.lines.dup").alias("n_dup_lines"), "q.n_repeat_words", "base_failed", "kept", F.sqrt("distance").alias("distance"))


def filtered(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of docs that verdicts() keeps, with the columns of docs."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("text"), *[F.col(k).cast("string").alias(k) for k in keys])
    scored = materialise(statistics(packed).drop("text"), "quality")
    return judged(scored, keys).where("kept").select(*[F.col("row").getField(c).alias(c) for c in names])
