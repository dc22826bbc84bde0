"""Operator 13: texts cut in three for filling in the middle, the cuts found by relations of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage_folder, text_of

#: A unit is a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents in a hundred that are cut, and of these those whose suffix comes first.
CUT, SUFFIX_FIRST, SEED = 50, 80, 42
KEYS = ("key_1", "key_2")


def _drawn(id_: Column, seed: int, k: int) -> Column:
    """The k-th unsigned number of 32 bits in the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """id, text, h3, h4 and two hashes that tell documents by id and text."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    keys = {key: F.xxhash64(F.lit(k), "id", "text") for k, key in enumerate(KEYS, 1)}
    return rows.withColumns({f"h{k}": _drawn(F.col("id"), seed, k) for k in (3, 4)} | keys)


def _offsets(cut: DataFrame, seed: int) -> DataFrame:
    """key_1, key_2, n, prefix_chars, middle_chars of every document that is cut, in the shared folder.

    Documents that are the same come down to one before anything is shuffled, so no key is a group that grows. Lengths of units are
    shuffled, texts are not: what is kept of a text are the lengths up to its second cut.
    """
    spark = cut.sparkSession
    folder = stage_folder(spark)
    units = cut.select(*KEYS, "id", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"))
    n = F.size("units")
    asked = [F.pmod(_drawn(F.col("id"), seed, k), n + 1).cast("int") for k in (1, 2)]
    cuts = units.withColumns({"n": n.cast("long"), "first": F.least(*asked), "second": F.greatest(*asked)})
    # Ordinal k stands for the place after k units, so before the first unit there is one without length.
    lengths = F.concat(F.array(F.lit(0)), F.transform(F.slice("units", F.lit(1), F.col("second")), lambda u: F.char_length(u)))
    cuts.select(*KEYS, "n", "first", "second", lengths.alias("lengths")).dropDuplicates(list(KEYS)).write.parquet(f"{folder}/units")
    kept = spark.read.parquet(f"{folder}/units")

    # Lengths are dealt by document before they become rows, so the window and the join move no row.
    placed = kept.select(*KEYS, "lengths").repartition(*KEYS).select(*KEYS, F.posexplode("lengths").alias("ordinal", "length"))
    running = Window.partitionBy(*KEYS).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.select(*KEYS, "ordinal", F.sum("length").over(running).alias("end"))
    requests = kept.select(*[F.col(k).alias(f"of_{k}") for k in KEYS], "n", F.posexplode(F.array("first", "second")).alias("which", "asked"))
    # The ordinals meet by a difference, which is no key of the join: so the units stay where the window has them.
    met = ends.join(requests, (F.col("key_1") == F.col("of_key_1")) & (F.col("key_2") == F.col("of_key_2")) & (F.col("ordinal") - F.col("asked") == 0))
    ends_of = [F.max(F.when(F.col("which") == k, F.col("end"))).alias(name) for k, name in enumerate(("prefix_chars", "upto"))]
    found = met.groupBy(*KEYS).agg(F.max("n").alias("n"), *ends_of)
    found.select(*KEYS, "n", "prefix_chars", (F.col("upto") - F.col("prefix_chars")).alias("middle_chars")).write.parquet(f"{folder}/offsets")
    return spark.read.parquet(f"{folder}/offsets")


def fill_in_middle(docs: DataFrame, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output of every row.

    A text of n units is cut after min(h1 % (n + 1), h2 % (n + 1)) units and after the larger of the two; h1 to h4 are drawn from
    the id. Of a hundred documents `cut` are cut, and of these `suffix_first` in a hundred start with the suffix (spm), the others with
    the prefix (psm). Empty and null texts, and those that hold one of the marks, stay as they are (plain, no chars). Rows of
    one id and text get one answer each; a null id is drawn for as an empty one; other columns are not read. Very long texts
    are cut like any other; no documents give no rows.

    Lengths of units are exploded and summed over a window, cuts join them by ordinal, and offsets are brought together by document;
    only texts that are cut are shuffled, to meet their offsets. Both tables in between are written to the checkpoint folder.
    """
    rows = _rows(docs, id_col, text_col, seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.pmod("h3", F.lit(100)) >= cut) | (F.col("text") == "") | marked
    whole = rows.where(plain).select(
        "id", F.size(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).cast("long").alias("n"), F.lit("plain").alias("form"), F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"), F.col("text").alias("output")
    )
    found = rows.where(~plain).join(_offsets(rows.where(~plain), seed).hint("shuffle_hash"), list(KEYS))
    till = F.col("prefix_chars") + F.col("middle_chars")
    prefix, middle, suffix = (F.substring("text", *x) for x in ((F.lit(1), F.col("prefix_chars").cast("int")), ((F.col("prefix_chars") + 1).cast("int"), F.col("middle_chars").cast("int")), ((till + 1).cast("int"), F.char_length("text"))))
    form = F.when(F.pmod("h4", F.lit(100)) < suffix_first, "spm").otherwise("psm")
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    parted = found.select("id", "n", form.alias("form"), "prefix_chars", "middle_chars", F.when(form == "spm", spm).otherwise(psm).alias("output"))
    return whole.unionByName(parted).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: what stands between the marks, in the text's order."""

    def parts(lead: str, inner: str) -> tuple[Column, Column, Column]:
        a, b, size = F.instr(output, inner), F.instr(output, MIDDLE), F.lit(len(lead))
        return F.substring(output, size + 1, a - size - 1), F.substring(output, a + size, b - a - size), F.substring(output, b + size, F.char_length(output))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    late_suffix, late_prefix, late_middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, late_middle, late_suffix)).otherwise(output)


def oracle_sql(cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> str:
    """DuckDB SQL for the query's rows by slices of each text's own list of units."""
    h = {k: f"('0x' || substr(h, {8 * k - 7}, 8))::BIGINT" for k in (1, 2, 3, 4)}
    return f"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS us, sha256('{seed}:' || doc_id::VARCHAR) AS h FROM documents),
c AS (SELECT *, len(us)::BIGINT AS n, least({h[1]} % (len(us) + 1), {h[2]} % (len(us) + 1)) AS a, greatest({h[1]} % (len(us) + 1), {h[2]} % (len(us) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {h[3]} % 100 >= {cut} THEN 'plain' WHEN {h[4]} % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
