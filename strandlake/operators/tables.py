"""Joins, filters, rankings and set operations on annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.graph import ensure_checkpoints


def carried_tag(rows: DataFrame, is_tag, tag) -> DataFrame:
    """Each row gets the tag of the last tag row before it, by ``part`` and ``ord``; tag rows go."""
    order = Window.partitionBy("part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("tag", F.last(F.when(is_tag, tag), ignorenulls=True).over(order)).filter(~is_tag)


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__k = 1").drop("__k")


def last_per_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def without_repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once; of a repeated key all rows go."""
    once = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").select(key)
    return rows.join(once, key, "left_semi")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def in_master_order(master: DataFrame, rows: DataFrame, key: str, value: str, missing: str = "NA") -> DataFrame:
    """Every master row (key, ord) with the first matching value, or ``missing``."""
    first = rows.groupBy(key).agg(F.min(value).alias(value))
    return master.join(first, key, "left").select(key, "ord", F.coalesce(value, F.lit(missing)).alias(value))


def having_all(rows: DataFrame, key: str, item: str, wanted: list[str]) -> DataFrame:
    """Keys that have every wanted item (relational division)."""
    return rows.filter(F.col(item).isin(*wanted)).groupBy(key).agg(F.count_distinct(item).alias("n")).filter(F.col("n") == len(wanted)).select(key)


def memoised(rows: DataFrame, key: str, operator) -> DataFrame:
    """Runs a costly operator on distinct keys only and joins its result back."""
    return rows.join(operator(rows.select(key).distinct()), key, "left")


def evaluated(taxa: DataFrame, summary: DataFrame) -> DataFrame:
    """Every taxon with the summary rows that name it, NA where none does."""
    found = taxa.join(summary, F.contains(F.col("label"), F.col("taxon")), "left")
    return found.select("taxon", F.coalesce("label", F.lit("NA")).alias("label"), "value")


def side_by_side(*parts: DataFrame) -> DataFrame:
    """Joins alignments (ord, id, seq) row by row; the first names the rows."""
    out = parts[0].select("ord", "id", F.col("seq").alias("s0"))
    for k, p in enumerate(parts[1:], 1):
        out = out.join(p.select("ord", F.col("seq").alias(f"s{k}")), "ord", "left")
    return out.select("ord", "id", F.concat(*(F.coalesce(f"s{k}", F.lit("")) for k in range(len(parts)))).alias("seq"))


def quality_checked(rows: DataFrame, passed: DataFrame) -> DataFrame:
    """All rows with otu of those that passed (accession, otu), ``failedqc`` for the rest."""
    return rows.join(passed, "accession", "left").withColumn("otu", F.coalesce("otu", F.lit("failedqc")))


def buckets(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows dealt in order to buckets of ``size``, per ``part``."""
    return rows.withColumn("bucket", F.floor((F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1) / size))


def _candidates(words: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """Pairs (w, name) among which are all within ``most`` edits.

    Of ``most`` + 1 segments of a name one stands unchanged in such a word, shifted by
    at most ``most``. With more than two edits segments get short, and names of nearly
    the word's length are taken.
    """
    near = F.explode(F.sequence(F.greatest(F.length("w") - most, F.lit(0)), F.length("w") + most))
    words, names = words.select("w", near.alias("size")), names.select("name", F.length("name").alias("size"))
    if most > 2:
        return words.join(names, "size")
    start = lambda i: F.floor(F.col("size") * i / (most + 1)).cast("int")
    segment = lambda text, i, by: F.struct(F.lit(i).alias("i"), F.substring(text, start(i) + 1 + by, start(i + 1) - start(i)).alias("part"))
    words = words.withColumn("key", F.explode(F.array_distinct(F.array(*(segment("w", i, by) for i in range(most + 1) for by in range(-most, most + 1))))))
    names = names.withColumn("key", F.explode(F.array(*(segment("name", i, 0) for i in range(most + 1)))))
    return words.join(names, ["size", "key"]).select("w", "name").distinct()


def nearest(words: DataFrame, names: DataFrame) -> DataFrame:
    """w, nearest, distance: for each word (w) the name at the least edit distance, ties by order of names.

    The cutoff doubles until every word has a name within it. A pair goes to the full
    distance when the letters that the name lacks are no more than the cutoff.
    """
    ensure_checkpoints(words.sparkSession)
    words, names = words.filter("w IS NOT NULL").distinct().checkpoint(), names.filter("name IS NOT NULL").distinct().checkpoint()
    longest = lambda rows, c: rows.agg(F.max(F.length(c))).first()[0]
    some, full = longest(names, "name") is not None, max(longest(words, "w") or 0, longest(names, "name") or 0)
    letters = lambda c: F.array_distinct(F.split(c, ""))
    found, most = [], 1
    while True:
        pairs = _candidates(words, names, most).filter(F.size(F.array_except(letters("w"), letters("name"))) <= most)
        pairs = pairs.withColumn("d", F.levenshtein("w", "name", most)).filter("d >= 0")
        found.append(pairs.groupBy("w").agg(F.min(F.struct("d", "name")).alias("m")).select("w", F.col("m.name").alias("nearest"), F.col("m.d").alias("distance")).checkpoint())
        words = words.join(found[-1], "w", "left_anti").checkpoint()
        if not some or most >= full or words.isEmpty():
            break
        most *= 2
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def renamed_by_place(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (place, seq) with the name of the same place (place, name), blanks as _; rows beyond the names are left out."""
    return rows.join(names.select("place", F.translate("name", " ", "_").alias("label")), "place")


def discrepant(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows (id, name, seq) whose name is in another number of clusters (name, otu) than one, with that number (times)."""
    times = clusters.groupBy("name").agg(F.count_distinct("otu").alias("times")).filter("times <> 1")
    return rows.join(times, "name").select("id", "seq", "times")


def site_shards(rows: DataFrame, compat: bool = False, exemplar: str | None = None) -> DataFrame:
    """site, ord, value: FASTA records by site, the last field of ids read|accession|taxon|identity|site.

    Ids become read|accession|identity|taxon. With ``exemplar`` each site begins with
    that record (ord null). ``compat`` leaves out each site's first record. To be
    written by site: ``write.partitionBy("site").text``.
    """
    part = lambda k: F.coalesce(F.get(F.split("id", "[|]"), F.lit(k)), F.lit(""))
    value = F.concat(F.lit(">"), F.concat_ws("|", part(0), part(1), part(3), part(2)), F.lit("\n"), F.col("seq"))
    out = rows.select(part(4).alias("site"), "ord", value.alias("value"))
    sites = out.groupBy("site").agg(F.min("ord").alias("first"))
    if compat:
        out = out.join(sites, "site").filter(F.col("ord") > F.col("first")).drop("first")
    if exemplar is not None:
        out = sites.select("site", F.lit(None).cast("long").alias("ord"), F.lit(exemplar).alias("value")).unionByName(out.withColumn("ord", F.col("ord").cast("long")))
    return out
