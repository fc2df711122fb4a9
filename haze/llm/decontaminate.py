"""Benchmark decontamination: a hash set of normalised test n-grams against every training window.

Words are the maximal runs of letters, digits and non-ASCII characters after lower-casing A-Z.  A
benchmark item contributes each of its windows of ``WIDTH`` words (all its words as one window when
it has fewer).  Every window of every text is looked up by a 64-bit hash and a hit is verified
on the words themselves.  The set is broadcast only when its counted size is below
``BROADCAST_BYTES``; beyond that the hashes of all windows meet it in a shuffle join.

Candidates are gathered per distinct text (a digest of the text is the key), so copies, repeated rows and
null ids need no row number; a heavily copied text is reduced before that shuffle, and its rows meet the
one candidate row in a join that can split them.

Defined cases: null or empty texts and items have no words and no hits; repeated items count once;
an item id is compared as a string, null as ``null``; an empty table gives an empty result, an empty benchmark no
hits; other columns travel in a struct and pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haze.llm._sql import let, lower_ascii, tokens
from haze.session import written

WIDTH = 10
BROADCAST_BYTES = 64 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return tokens(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _grams(words: Column, width: int) -> Column:
    """Hash of the ``width`` words at each position; empty for shorter texts."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - F.lit(width)),
        lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(width)])))
    return F.when(F.size(words) >= width, grams).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                 width: int = WIDTH) -> DataFrame:
    """Distinct windows (h, size, words) with the sorted set of the ids that hold them."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
                             words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(width), F.size("w"))
    cut = items.select("item", size.alias("size"), F.explode(F.expr(
        f"transform(sequence(0, size(w) - least({width}, size(w))), i -> slice(w, i + 1, least({width}, size(w))))"))
        .alias("words"))
    by_size = F.lit(None).cast("bigint")
    for n in range(1, width + 1):
        by_size = F.when(F.col("size") == n, F.get(_grams(F.col("words"), n), F.lit(0))).otherwise(by_size)
    return cut.withColumn("h", by_size).groupBy("h", "size", "words").agg(
        F.sort_array(F.collect_set("item")).alias("items"))


def candidates(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text",
              item_id: str = "item_id", width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """key and near (pos, n, words, items) of each distinct text with a window hash of the set."""
    windows = item_windows(benchmark, item_text, item_id, width)
    bound = windows.groupBy("size").agg(F.sum(
        F.lit(64) + F.size("words") * 16 + F.octet_length(F.array_join("words", ""))
        + F.octet_length(F.array_join("items", "")) + F.size("items") * 16).alias("bytes")).collect()  # <= width rows
    if bound and sum(r["bytes"] for r in bound) <= broadcast_bytes:
        windows = F.broadcast(windows)
    texts = docs.select(_key(F.col(text)).alias("key"), words_of(F.col(text)).alias("doc_words"))
    # positions and hashes alone meet the windows: carrying the words through would copy them per position
    sizes = sorted(r["size"] for r in bound)
    if len(sizes) == 1:  # the usual case: plain hashes, no struct per position
        at = texts.select("key", F.posexplode(_grams(F.col("doc_words"), sizes[0])).alias("pos", "g"))
        at = at.withColumn("n", F.lit(sizes[0]))
    else:
        none = F.array().cast("array<struct<n:int,pos:int,g:bigint>>")
        entry = lambda n: lambda g, i: F.struct(F.lit(n).alias("n"), i.alias("pos"), g.alias("g"))
        entries = F.concat(none, *[F.transform(_grams(F.col("doc_words"), n), entry(n)) for n in sizes])
        at = texts.select("key", F.explode(entries).alias("e")).select("key", "e.*")
    near = at.join(windows, (F.col("g") == F.col("h")) & (F.col("n") == F.col("size"))).groupBy("key").agg(
        F.collect_set(F.struct("pos", "n", "words", "items")).alias("near"))
    return written(near, "dc-near")


def covered(hits: Column) -> Column:
    """Number of words inside the union of sorted (pos, end) intervals, in one linear pass."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["pos"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], x["end"]).alias("end"))
    return F.aggregate(hits, zero, step, lambda acc: acc["n"])


def annotated(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
              **kw) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) as struct ``row`` with n_words, n_hit, items and hits."""
    near = candidates(docs, benchmark, text, **kw)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(text).alias("body"),
                       _key(F.col(text)).alias("doc_key"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    # a row with candidates verifies them on its own words: nothing is gathered by text, so copies spread
    sure = F.when(F.col("near").isNotNull(), let(words_of(F.col("body")), lambda w: F.filter(
        "near", lambda x: F.slice(w, x["pos"] + 1, x["n"]) == x["words"])))
    found = rows.join(near, F.col("doc_key") == F.col("key"), "left").select("row", "n_words", sure.alias("sure"))
    found = found.select(
        "row", "n_words",
        F.array_sort(F.transform("sure", lambda x: F.struct(x["pos"].alias("pos"), (x["pos"] + x["n"]).alias("end")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("sure", lambda x: x["items"])))).alias("items"))
    none = F.array().cast("array<string>")
    return found.select("row", "n_words", F.coalesce(covered(F.col("hits")), F.lit(0)).cast("long").alias("n_hit"),
                        F.coalesce("items", none).alias("items"), "hits")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "spans", **kw) -> DataFrame:
    """``docs`` without contaminated documents, or without their contaminated word spans.

    With ``remove="spans"`` the words of every hit and the separators after them leave the text;
    a document of which no word remains leaves as a whole.  Clean documents are returned as they are.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'")
    rows = annotated(docs, benchmark, text, **kw)
    if remove == "documents":
        return rows.where(F.col("n_hit") == 0).select("row.*")
    # lead separators, then alternating word + following separators: one piece per word
    low = lower_ascii(F.col(f"row.`{text}`"))
    lead = F.regexp_extract(low, r"^([\x00-\x2F\x3A-\x60\x7B-\x7F]*)", 1)
    raw = F.substr(F.col(f"row.`{text}`"), F.char_length(lead) + 1)
    pieces = F.regexp_extract_all(raw, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), 1)
    hit = F.flatten(F.transform("hits", lambda x: F.sequence(x["pos"], x["end"] - F.lit(1))))
    left = F.array_except(F.sequence(F.lit(0), F.col("n_words").cast("int") - F.lit(1)), hit)
    kept = let(pieces, lambda p: F.array_join(F.transform(left, lambda i: F.get(p, i)), ""))
    text_out = F.when(F.col("n_hit") == 0, F.col(f"row.`{text}`")).otherwise(F.when(F.col("n_hit") < F.col("n_words"), F.concat(lead, kept)))
    out = rows.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return out.withColumn("_text_out", text_out).select(*[
        F.col("_text_out").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
