"""Document fingerprints by consistent weighted sampling (operator 3), with DataFrame functions only.

Terms are the words of a text, their weights the counts. For sample k a term draws, from hashes of term and k alone, two
gamma variables r, c ~ Gamma(2, 1) and a uniform b; with weight S it takes t = floor(ln S / r + b) and bids
ln a = ln c - r (t - b + 1). The term with the lowest bid, together with t, is the sample. Two texts agree in a sample
with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima of the weights.

A bid and 29 bits that name (term, t) are packed into one long, so a sample is a minimum of longs: whole-stage code, pre-
aggregated by hash. The samples come in chunks of 4, a row for each, which keeps the generated methods small enough to be
compiled.

With weight S a bid's a is exponentially distributed at rate S, so the lowest of a text of n words lies below MOST / n but for a
chance of exp(-MOST), 4e-18. Two products of uniforms bound a from below without a logarithm; where the bound exceeds that limit
the rest of the bid is not worked out. A lowest bid below its limit is the lowest of all; should one lie above, the job fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylantern.llm.common import parts, settle, total

SAMPLES, CHUNK = 64, 4
#: Bids that are worked out: those that may lie below this over the words of the text.
MOST = 40.0
#: Documents of neighbouring ids in one group of the window that finds the next document.
GROUP_BITS = 6
#: Text that one task samples, about.
TASK_BYTES = 8_000_000
BLANK = r" \t\n\r\f\x0b"


def uniforms(x: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1) from a 64-bit hash."""
    return (F.shiftrightunsigned(x, 32) + 0.5) * 2.0**-32, (x.bitwiseAND(F.lit(0xFFFFFFFF)) + 0.5) * 2.0**-32


def draws(chunks: DataFrame, kept: list[str]) -> DataFrame:
    """The columns kept and what each term draws for the samples of its chunk whatever its weight: r, ln c, b and 29 bits that name the term (n).

    They are null where a cannot be below `limit` (null: no limit), by a >= c exp(-r) / S and c = -ln(y) >= 2 (1 - y) / (1 + y).
    """
    number = lambda k: F.col("chunk") * CHUNK + k
    product = lambda k, j: _product(F.xxhash64("term", number(k), F.lit(j)))
    each = range(CHUNK)
    tried = chunks.select("*", *(product(k, j).alias(f"{n}{k}") for k in each for n, j in (("x", 1), ("y", 2))))
    low = lambda k: F.col(f"x{k}") * (1 - F.col(f"y{k}")) * 2.0
    tried = tried.select("*", *(F.coalesce(low(k) <= F.col("limit") * (F.col(f"y{k}") + 1.0), F.lit(True)).alias(f"ok{k}") for k in each))
    parts = lambda k: {"r": -F.log(f"x{k}"), "c": F.log(-F.log(f"y{k}")), "own": F.xxhash64("term", number(k), F.lit(3))}
    drawn = tried.select(*kept, *(F.when(F.col(f"ok{k}"), x).alias(f"{n}{k}") for k in each for n, x in parts(k).items()))
    name = lambda k: F.col(f"own{k}").bitwiseAND(F.lit((1 << 29) - 1))
    return drawn.select(*kept, *(x.alias(f"{n}{k}") for k in each for n, x in (("r", F.col(f"r{k}")), ("c", F.col(f"c{k}")), ("b", uniforms(F.col(f"own{k}"))[0]), ("n", name(k)))))


def bid(r: Column, c: Column, b: Column, name: Column, log_weight: Column) -> Column:
    """The packed bid of a term with that weight; null where the weight is 0 and its logarithm null."""
    t = F.floor(log_weight / r + b)
    low = F.floor((c - r * (t - b + 1) + 128.0) * 2.0**26)
    return F.shiftleft(low, 29).bitwiseOR(name.bitwiseXOR((t * 0x9E3779B1).bitwiseAND(F.lit((1 << 29) - 1))))


def _product(x: Column) -> Column:
    u, v = uniforms(x)
    return u * v


def successors(keys: DataFrame, levels: int = 4) -> DataFrame:
    """key and the next larger key, null for the largest. Keys are distinct; 12 bits are split off at each level, so no window holds more than 4096 rows."""
    if not levels:
        return keys.select("key", F.lead("key").over(Window.orderBy("key")).alias("next"))
    own = keys.withColumn("above", F.shiftright("key", 12))
    above = own.groupBy("above").agg(F.min("key").alias("first"))
    up = successors(above.select(F.col("above").alias("key")), levels - 1)
    beyond = up.join(above.withColumnRenamed("above", "next"), "next").select(F.col("key").alias("above"), "first")
    inner = own.withColumn("inner", F.lead("key").over(Window.partitionBy("above").orderBy("key")))
    return inner.join(beyond, "above", "left").select("key", F.coalesce("inner", "first").alias("next"))


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """Groups of neighbouring documents in descending order of id: group, place, doc_id, text, next_text, and whether the row ends its group.

    The next document after the last is the first. Rows without an id come last; they and rows of equal id follow each other by
    their texts' hash. Rows without an id are grouped by the high bits of that hash, as many as give about 64 rows a group;
    the same text without an id stays in one group. Texts are shuffled once, by group; the document that follows a group, one
    in 64, once more.
    """
    bits = max(1, (total(docs, F.col("doc_id").isNull().cast("int")) >> GROUP_BITS).bit_length())
    nameless = F.lit(-(2**58)) - F.shiftright(F.xxhash64("text"), 64 - bits)  # descending as the hash ascends, below all groups of ids
    group = F.when(F.col("doc_id").isNull(), nameless).otherwise(F.shiftright("doc_id", GROUP_BITS))
    rows = docs.select("text", F.coalesce("doc_id", F.lit(-(2**63))).alias("o"), group.alias("group"))  # the same columns in each use, so that the exchange of texts is shared
    tops = settle(rows.groupBy("group").agg(F.max("o").alias("top")), "tops")
    ends = tops.agg(F.min("group"), F.max("group")).first()
    following = successors(tops.select(F.col("group").alias("key"))).select(F.col("key").alias("group"), F.coalesce("next", F.lit(ends[0])).alias("before"))
    heads = settle(tops.join(following, "group"), "heads")
    dealt = rows.repartition(n, "group")
    order = Window.partitionBy("group").orderBy(F.col("o").desc(), F.xxhash64("text"))
    placed = dealt.select(
        "group", F.when(F.col("group") >= -(2**57), F.col("o")).alias("doc_id"), "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("inner_text"), F.lead(F.lit(1)).over(order).isNull().alias("ends")
    )
    tails = dealt.join(heads, "group").filter("o = top").groupBy("before").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    tails = tails.select(F.col("before").alias("group"), F.col("x.text").alias("tail_text"))
    joined = placed.join(tails.repartition(n, "group"), "group", "left")
    return joined.select("group", "place", "doc_id", "text", F.when(F.col("ends"), F.col("tail_text")).otherwise(F.col("inner_text")).alias("next_text"), "ends")


def term_weights(rows: DataFrame) -> DataFrame:
    """group, place, term (hash), its counts w in the text and v in the edited text, and where it occurs there the words of those texts, n_w and n_v.

    The document after a group stands at one place more.
    """
    texts = F.array(
        F.struct("place", F.lit(0).alias("edited"), F.col("text").alias("t")),
        F.struct("place", F.lit(1).alias("edited"), F.col("edited_text").alias("t")),
        F.when(F.col("ends"), F.struct((F.col("place") + 1).alias("place"), F.lit(0).alias("edited"), F.col("next_text").alias("t"))),
    )
    each = rows.select("group", F.explode(texts).alias("x")).filter("x IS NOT NULL").select("group", "x.place", "x.edited", F.col("x.t").alias("t"))
    split = each.select("group", "place", "edited", F.split(F.btrim("t", F.lit(" \t\n\r\f\x0b")), f"[{BLANK}]+").alias("words"))
    words = split.select("group", "place", "edited", F.size("words").alias("size"), F.explode("words").alias("word"))
    of = lambda edited: F.max(F.when(F.col("edited") == edited, F.col("size")))
    sums = [F.sum(1 - F.col("edited")).alias("w"), F.sum("edited").alias("v"), of(0).alias("n_w"), of(1).alias("n_v")]
    return words.groupBy("group", "place", F.xxhash64("word").alias("term")).agg(*sums)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float | None = MOST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text has its last third, n_chars / 3 code points rounded down, replaced by as many from the start of the
    next document. A fingerprint has four hexadecimal digits for each of 64 samples; the likeness of two is the share of
    equal samples. A null text counts as empty; a text without words has the empty word as its only term, so such
    texts are alike. Repeated rows stay. most: as described above; without it every bid is worked out, with the same results.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = max(parts(docs), total(plain, F.octet_length("text")) // TASK_BYTES)
    rows = with_next(plain, n).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - cut as int))"), F.expr("substring(next_text, 1, cast(cut as int))"))
    rows = rows.withColumn("edited_text", edited)
    facts = rows.select("group", "place", "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"))
    limit = F.lit(most).cast("double") * F.greatest(F.col("w") / F.col("n_w"), F.col("v") / F.col("n_v")) * (1 + 1e-9)
    log = lambda c: F.log(F.nullif(c, F.lit(0))).alias(c)
    weights = term_weights(rows).select("group", "place", "term", log("w"), log("v"), "n_w", "n_v", limit.alias("limit"))
    chunks = weights.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // CHUNK - 1))))
    drawn = draws(chunks, ["group", "place", "chunk", "w", "v", "n_w", "n_v"])
    lows = [F.min(bid(*(F.col(f"{n}{k}") for n in "rcbn"), F.col(x))).alias(f"{x}{k}") for k in range(CHUNK) for x in "wv"]
    samples = drawn.groupBy("group", "place", "chunk").agg(*lows, F.max("n_w").alias("n_w"), F.max("n_v").alias("n_v"))
    digits = lambda c: F.array(*(F.xxhash64(f"{c}{k}").bitwiseAND(F.lit(0xFFFF)).cast("int") for k in range(CHUNK)))
    above = lambda c, k: (F.shiftright(f"{c}{k}", 29) + 1) * 2.0**-26 - 128.0 > F.log(F.lit(most) / F.col(f"n_{c}"))
    over = lambda c: F.col(f"n_{c}").isNotNull() & F.array_contains(F.array(*(F.coalesce(above(c, k), F.lit(True)) for k in range(CHUNK))), True)
    if most is not None:
        told = F.raise_error(F.lit(f"a lowest bid lies above {most} / words, where others were passed over: call fingerprints with a larger `most`"))
        samples = samples.withColumn("chunk", F.when(over("w") | over("v"), told.cast("int")).otherwise(F.col("chunk")))
    signed = samples.select("group", "place", "chunk", digits("w").alias("w"), digits("v").alias("v"))
    signed = signed.withColumn("after", F.lead("w").over(Window.partitionBy("group", "chunk").orderBy("place")))
    same = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")
    pieces = signed.select("group", "place", F.struct("chunk", text("w").alias("w"), text("v").alias("v")).alias("x"), same("w", "v").alias("m"), same("w", "after").alias("k"))
    whole = pieces.groupBy("group", "place").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("m").alias("m"), F.sum("k").alias("k"))
    joined = facts.join(whole, ["group", "place"])
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("x.w", "").alias("fingerprint"), F.array_join("x.v", "").alias("edited_fingerprint"),
        (F.col("m") / SAMPLES).alias("near_edited"), (F.col("k") / SAMPLES).alias("near_next"),
    )
