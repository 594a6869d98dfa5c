"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the rest.

Each source must supply its target share of the tokens of all documents. A document of weight w is wanted
lambda = min(c w, max_repeats) times, c set for each source so that the expected tokens meet the target. The whole part
of lambda is certain; the fraction is the inclusion probability pi of one more copy, drawn for a fixed number of
documents: those with the smallest ranking odds (U / (1 - U)) / (pi / (1 - pi)), U uniform by a hash of the document id.

The smallest are found without sorting a source in one task: a histogram of the ranks (BINS for each source) shows the
bin in which the sample ends, and only that bin's rows, about 1/BINS of the source, are put in order.

Defined results: sources match without letter case and surrounding blanks; documents without a listed source are not in
the mixture but count in the total; null text has no tokens; documents without tokens are never drawn; a target that is
null or not positive asks for nothing; repeated targets of a source count once (the largest); an unreachable target gives
every document max_repeats times and is reported; ties in rank go to the smaller id; an empty corpus gives zero shares.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.runtime import discard, salted_join, small, spread_out, written

BINS = 4096
#: From this length on, a stretch ends at the next place where the tokenizer's pattern ends a piece in any case: before a single blank between word characters.
STRETCH = 100_000
_PLACE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def normal_source(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def token_counts(docs: DataFrame, id_col: str, source: str, text: str, vocabulary: str) -> DataFrame:
    """(id, source, tokens) of every document; vocabulary: path of a .tiktoken file on every machine."""
    rows = docs.select(F.col(id_col).alias("id"), normal_source(F.col(source)).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def count(batches):
        import pyarrow as pa

        encoding = _encoding(vocabulary)
        for batch in batches:
            n = [sum(len(encoding.encode_ordinary(s)) for s in _stretches(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["source"], pa.array(n, pa.int64())], ["id", "source", "tokens"])

    return spread_out(rows).mapInArrow(count, f"id {id_type}, source string, tokens bigint")


def _encoding(vocabulary: str):
    """One encoding for each Python worker."""
    import base64

    import tiktoken

    kept = tiktoken.__dict__.setdefault("_kept_encodings", {})
    if vocabulary not in kept:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        kept[vocabulary] = tiktoken.Encoding("kept", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept[vocabulary]


def _stretches(text: str, size: int = STRETCH):
    a = 0
    while len(text) - a > size:
        place = _PLACE.search(text, a + size)
        if place is None:
            break
        yield text[a : place.start()]
        a = place.start()
    yield text[a:]


def _by_source(rows: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """Joins rows of any number to one row for each source: by broadcast if those are few, else with hot sources salted."""
    return rows.join(F.broadcast(few), "source", how) if small(few) else salted_join(rows, few, ["source"], F.col("id"), how)


def allocation(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: source, name (as given), target_share, max_repeats, docs, tokens, wanted (tokens), reachable. targets: source, target_share, max_repeats."""
    total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    sizes = counts.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    t = targets.select(F.col("source").alias("name"), normal_source(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(0)).alias("max_repeats"))
    t = t.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats", "name")).alias("t")).select("source", "t.*")
    both = t.join(sizes, "source", "left").fillna(0, ["docs", "tokens"]).join(F.broadcast(total))
    wanted = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)) * F.col("total")
    return both.select("source", "name", "target_share", "max_repeats", "docs", "tokens", wanted.alias("wanted"), (F.col("tokens") * F.col("max_repeats") >= wanted).alias("reachable"))


def _multiples(plan: DataFrame, counts: DataFrame, weight: Column) -> DataFrame:
    """plan with c: lambda = min(c w, max_repeats) meets `wanted`. Solved over (source, tokens) counts, by rising c until no document newly hits its cap.

    Each round caps at least one more size of document, so the rounds end.
    """
    spark = counts.sparkSession
    sizes, sizes_path = written(counts.where("tokens > 0").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).withColumn("w", weight).withColumn("id", F.col("tokens")), "sizes")
    plan, path = written(plan.withColumn("c", F.lit(0.0)), "plan")
    while True:
        capped = F.col("c") * F.col("w") >= F.col("max_repeats")
        sums = _by_source(sizes, plan.select("source", "c", "max_repeats")).groupBy("source").agg(
            F.sum(F.when(capped, F.col("n") * F.col("tokens") * F.col("max_repeats")).otherwise(0)).alias("fixed"),
            F.sum(F.when(~capped, F.col("n") * F.col("tokens") * F.col("w")).otherwise(0.0)).alias("open"),
        )
        more = F.when(F.col("reachable") & (F.col("open") > 0), F.greatest("c", (F.col("wanted") - F.col("fixed")) / F.col("open"))).when(~F.col("reachable") & (F.col("tokens") > 0), F.lit(float("inf"))).otherwise(F.col("c"))
        new, new_path = written(plan.join(sums, "source", "left").withColumn("before", F.col("c")).withColumn("c", more).drop("fixed", "open"), "plan")
        risen = not new.where("c > before * (1 + 1e-12) and c < double('infinity')").isEmpty()
        discard(spark, path)
        plan, path = new.drop("before"), new_path
        if not risen:
            break
    discard(spark, sizes_path)
    return plan


def mixture(counts: DataFrame, targets: DataFrame, seed: int = 7, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, plan): copies has id, source, tokens, copies (1 or more); weight: of a document, by its tokens (all 1 by default)."""
    weight = F.lit(1.0) if weight is None else weight
    plan = _multiples(allocation(counts, targets), counts, weight)
    docs = _by_source(counts.where("tokens > 0"), plan.select("source", "c", "max_repeats").where("c > 0")).withColumn("w", weight)
    # c w is infinite for an unreachable target, which the cap turns into max_repeats
    docs = docs.withColumn("lam", F.least(F.col("c") * F.col("w"), F.col("max_repeats").cast("double")))
    docs = docs.withColumn("sure", F.floor(F.col("lam") + 1e-9)).withColumn("pi", F.greatest(F.col("lam") - F.col("sure"), F.lit(0.0)))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    odds = F.when(F.col("pi") > 1e-9, (u / (1 - u)) * (1 - F.col("pi")) / F.col("pi"))
    docs = docs.withColumn("rank", odds / (1 + odds)).withColumn("bin", F.floor(F.col("rank") * BINS))
    docs, _ = written(docs.select("id", "source", "tokens", "sure", "pi", "rank", "bin"), "ranked")
    bins = docs.where("bin is not null").groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("pi").alias("pi"))
    w = Window.partitionBy("source").orderBy("bin")  # at most BINS rows for each target
    cum = bins.withColumns({"upto": F.sum("n").over(w), "size": F.round(F.sum("pi").over(Window.partitionBy("source")))})
    end = cum.where(F.col("upto") >= F.col("size")).groupBy("source").agg(F.min(F.struct("bin", (F.col("size") - F.col("upto") + F.col("n")).alias("take"))).alias("e")).select("source", F.col("e.bin").alias("end"), F.col("e.take").alias("take"))
    marked = _by_source(docs, end, "left")
    last = Window.partitionBy("source").orderBy("rank", F.col("id"))
    tail = marked.where("bin = end").withColumn("k", F.row_number().over(last)).where("k <= take").withColumn("more", F.lit(1)).drop("k")
    drawn = marked.where("bin < end").withColumn("more", F.lit(1)).unionByName(tail).select("id", "source", "tokens", (F.col("sure") + 1).alias("copies"))
    kept = tail.select("id", F.lit(True).alias("in_tail"))
    rest = marked.where("sure > 0 and (end is null or bin is null or bin > end)").select("id", "source", "tokens", F.col("sure").alias("copies"))
    missed = marked.where("sure > 0 and bin = end").join(kept, "id", "left_anti").select("id", "source", "tokens", F.col("sure").alias("copies"))
    out = drawn.unionByName(rest).unionByName(missed)
    return out.withColumn("copies", F.col("copies").cast("bigint")), plan


def shares(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """What was drawn for each target: target share, actual share of the mixture and of the tokens of all documents (null for a target of zero), the most copies of a document, and short: every document is in max_repeats times, and still there is too little."""
    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"), F.max("copies").alias("most"))
    whole = copies.agg(F.sum(F.col("tokens") * F.col("copies")).alias("all_tokens"))
    drawn = F.coalesce("got", F.lit(0)).cast("bigint")
    return plan.alias("plan").join(got, "source", "left").join(F.broadcast(whole)).select(
        F.col("name").alias("source"), "target_share", F.round(F.coalesce(F.try_divide("got", "all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        F.round(F.try_divide(drawn * F.col("target_share"), "wanted"), 6).alias("corpus_share"), drawn.alias("tokens"), F.coalesce("most", F.lit(0)).alias("most_copies"),
        ((drawn < F.col("wanted")) & (drawn >= F.col("plan.tokens") * F.col("max_repeats"))).alias("short"),
    )
