"""Words against segments (SAC) and summaries against references (ICS, CR, HR, ROUGE-L)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoq.functions.text import is_meaningful, normalize, token_count, tokenize
from convoq.operators.intervals import active_segment

#: Fixed values of the scores.
TOP_WEIGHTS = (0.5, 0.3, 0.2)
LAYER_WEIGHTS = {"participant": 1.5, "topic": 1.0, "meeting": 2.0}
SIMILAR, OVERLAPS = 0.50, 0.30


def attributed_words(words: DataFrame, segments: DataFrame, match: str = "substring") -> DataFrame:
    """Meaningful words (meeting_id, word_idx, speaker, covered, pred): pred is the active segment's speaker.

    A word is covered if the active segment's text contains it, as a substring or (match='token') as a word.
    """
    w = words.where(is_meaningful(F.col("word")))
    a = active_segment(w, "start_ms", segments)
    word, text = F.lower(F.trim(F.col("word"))), F.lower(F.col("seg_text"))
    hit = text.contains(word) if match == "substring" else F.array_contains(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), word)
    return a.select("meeting_id", "word_idx", "speaker", F.coalesce(hit, F.lit(False)).alias("covered"), F.col("seg_speaker").alias("pred"))


def speaker_map(attributed: DataFrame) -> DataFrame:
    """(meeting_id, speaker, pred, n): the predicted speaker of most covered words, ties to the one seen first."""
    n = attributed.where("covered").groupBy("meeting_id", "speaker", "pred").agg(F.count("*").alias("n"), F.min("word_idx").alias("__first"))
    best = F.row_number().over(Window.partitionBy("meeting_id", "speaker").orderBy(F.desc("n"), "__first"))
    return n.withColumn("__r", best).where("__r = 1").select("meeting_id", "speaker", "pred", "n")


def sac(attributed: DataFrame) -> DataFrame:
    """(meeting_id, n_words, n_covered, n_matched): the counts that coverage, accuracy and SAC are made of."""
    m = speaker_map(attributed).select("meeting_id", "speaker", F.col("pred").alias("__to"))
    j = attributed.join(m, ["meeting_id", "speaker"], "left")
    return j.groupBy("meeting_id").agg(
        F.count("*").alias("n_words"), F.count_if("covered").alias("n_covered"), F.count_if(F.coalesce(F.col("pred") == F.col("__to"), F.lit(False))).alias("n_matched")
    )


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.when(b > 0, F.round(a / b, digits)).otherwise(F.lit(0.0))


def text_chunks(df: DataFrame, keys: list[str], idx: str, least_chars: int = 6, least_tokens: int = 0) -> DataFrame:
    """(keys, chunk_idx, chunk): normalised sentences of at least least_chars characters and least_tokens tokens."""
    parts = F.transform(F.split("text", r"[.!?]+"), normalize)
    c = df.select(*keys, idx, F.posexplode(parts).alias("__p", "chunk")).where(F.length("chunk") >= least_chars)
    if least_tokens:
        c = c.where(token_count(F.col("chunk")) >= least_tokens)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(idx, "__p")) - 1
    return c.select(*keys, n.cast("long").alias("chunk_idx"), "chunk")


def _bag(chunk: Column) -> Column:
    """A chunk's distinct tokens as numbers."""
    return F.transform(F.array_distinct(tokenize(chunk)), lambda t: F.xxhash64(t))


def _measured(bag: Column, others: Column) -> Column:
    """For each of an array of (idx, bag): idx, n common tokens, overlap n / size of bag, similarity n / root of both sizes."""
    counted = F.transform(others, lambda o: F.struct(o["idx"].alias("idx"), F.size(F.array_intersect(bag, o["bag"])).alias("n"), F.size(o["bag"]).alias("size")))
    some = lambda o, x: F.when(o["n"] > 0, o["n"] / x).otherwise(F.lit(0.0))
    return F.transform(counted, lambda o: F.struct(o["idx"].alias("idx"), o["n"].alias("n"), some(o, F.size(bag)).alias("overlap"), some(o, F.sqrt((F.size(bag) * o["size"]).cast("double"))).alias("similarity")))


def _best(bag: Column, others: Column, k: int) -> Column:
    """The k of `others` with the largest overlap, ties to the later one."""
    order = F.transform(_measured(bag, others), lambda o: F.struct((-o["overlap"]).alias("o"), (-o["idx"]).alias("i"), o["similarity"].alias("s")))
    return F.transform(F.slice(F.array_sort(order), 1, k), lambda o: F.struct((-o["i"]).alias("idx"), (-o["o"]).alias("overlap"), o["s"].alias("similarity")))


def _closest(bag: Column, others: Column) -> Column:
    """The one of `others` with the largest similarity over 0, ties to the earlier one; null without any."""
    order = F.transform(F.filter(_measured(bag, others), lambda o: o["n"] > 0), lambda o: F.struct(o["similarity"].alias("s"), (-o["idx"]).alias("i"), o["overlap"].alias("o")))
    return F.array_max(order)


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by its keys to as many tasks as a shuffle has: comparing texts is much work for few bytes, so small partitions stay apart."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _gathered(chunks: DataFrame, keys: list[str]) -> DataFrame:
    return _spread(chunks, keys).groupBy(*keys).agg(F.collect_list(F.struct(F.col("chunk_idx").alias("idx"), _bag(F.col("chunk")).alias("bag"))).alias("__others"))


def best_chunks(gt: DataFrame, pred: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """(keys, gt_idx, rank, pred_idx, overlap, similarity): for each reference chunk the k predicted ones of largest
    token overlap, ties to the later chunk.

    A group's predicted chunks come to each reference chunk as one array, so pairs are compared in the row and only the
    k best become rows; a group is one layer of one meeting's summary.
    """
    g = _spread(gt, keys).select(*keys, F.col("chunk_idx").alias("gt_idx"), _bag(F.col("chunk")).alias("__bag")).join(_gathered(pred, keys), keys)
    top = g.select(*keys, "gt_idx", F.posexplode(_best(F.col("__bag"), F.col("__others"), k)).alias("rank", "b"))
    return top.select(*keys, "gt_idx", (F.col("rank") + 1).alias("rank"), F.col("b.idx").alias("pred_idx"), "b.overlap", "b.similarity")


def layer_ics(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_chunks, ics): mean coverage of the reference chunks; 0 without predictions."""
    best = best_chunks(gt, pred, keys)
    weight = F.element_at(F.array(*[F.lit(w) for w in TOP_WEIGHTS]), F.col("rank"))
    score = best.groupBy(*keys, "gt_idx").agg(F.least(F.lit(1.0), F.sum(weight * (0.7 * F.col("overlap") + 0.3 * F.col("similarity")))).alias("coverage"))
    all_ = gt.select(*keys, F.col("chunk_idx").alias("gt_idx")).join(score, [*keys, "gt_idx"], "left")
    return all_.groupBy(*keys).agg(F.count("*").alias("n_chunks"), F.avg(F.coalesce("coverage", F.lit(0.0))).alias("ics"))


def overall_ics(layers: DataFrame, by: str = "meeting_id") -> DataFrame:
    """(by, ics): layers weighted, absent layers as 0."""
    w = F
    for layer, x in LAYER_WEIGHTS.items():
        w = w.when(F.col("layer") == layer, x)
    return layers.groupBy(by).agg((F.sum(w.otherwise(0.0) * F.col("ics")) / sum(LAYER_WEIGHTS.values())).alias("ics"))


def compression(original: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_in, n_out): tokens of the original and of the summary."""
    n_in = original.groupBy(*by).agg(F.sum(token_count(F.col("text"))).cast("long").alias("n_in"))
    n_out = summary.groupBy(*by).agg(F.sum(token_count(F.col("text"))).cast("long").alias("n_out"))
    return n_in.join(n_out, by, "left").select(*by, "n_in", F.coalesce("n_out", F.lit(0).cast("long")).alias("n_out"))


def claim_support(claims: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, claim_idx, best_idx, similarity, overlap, unsupported): each claim against its most similar chunk.

    A group's chunks come to each claim as one array. A claim that shares no token with any chunk has similarity and
    overlap 0.
    """
    c = _spread(claims, keys).select(*keys, F.col("chunk_idx").alias("claim_idx"), _bag(F.col("chunk")).alias("__bag")).join(_gathered(chunks, keys), keys, "left")
    c = c.select(*keys, "claim_idx", _closest(F.col("__bag"), F.col("__others")).alias("b"))
    s, o = F.coalesce("b.s", F.lit(0.0)), F.coalesce("b.o", F.lit(0.0))
    return c.select(*keys, "claim_idx", (-F.col("b.i")).alias("best_idx"), s.alias("similarity"), o.alias("overlap"), ((s < SIMILAR) & (o < OVERLAPS)).alias("unsupported"))


def layer_scores(reference: DataFrame, predicted: DataFrame, keys: list[str], idx: str = "unit_idx", least_chars: int = 6, least_tokens: int = 4) -> DataFrame:
    """(keys, n_chunks, ics, n_claims, n_unsupported, n_in, n_out): coverage, support and compression of each layer at once.

    Texts (keys, idx, text) of both sides are cut and tokenised once and gathered by one shuffle; the scores are those of
    layer_ics, claim_support and compression. Only layers with reference texts have a row.
    """
    both = reference.select(*keys, F.lit(0).alias("side"), idx, "text").unionByName(predicted.select(*keys, F.lit(1).alias("side"), idx, "text"))
    parts = F.filter(F.transform(F.split("text", r"[.!?]+"), normalize), lambda c: F.length(c) >= least_chars)
    made = F.transform(parts, lambda c: F.struct(token_count(c).alias("n"), _bag(c).alias("bag")))
    side = lambda k, x: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct(F.col(idx).alias("o"), made.alias("x"))))), lambda u: u["x"])).alias(x)
    tokens = lambda k: F.sum(F.when(F.col("side") == k, token_count(F.col("text"))).otherwise(0)).cast("long")
    g = _spread(both, keys).groupBy(*keys).agg(side(0, "gt"), side(1, "pred"), F.count_if(F.col("side") == 0).alias("units"), tokens(0).alias("n_in"), tokens(1).alias("n_out")).where("units > 0")
    number = lambda a: F.transform(a, lambda c, i: F.struct(i.alias("idx"), c["bag"].alias("bag")))
    g = g.select(*keys, "n_in", "n_out", F.filter("gt", lambda c: c["n"] >= least_tokens).alias("main"), number("gt").alias("gt"), number("pred").alias("pred"))
    weights = F.array(*[F.lit(w) for w in TOP_WEIGHTS])
    worth = lambda top: F.aggregate(F.transform(top, lambda b, i: F.element_at(weights, i + 1) * (0.7 * b["overlap"] + 0.3 * b["similarity"])), F.lit(0.0), lambda s, x: s + x)
    covered = F.transform("main", lambda c: F.least(F.lit(1.0), worth(_best(c["bag"], F.col("pred"), len(TOP_WEIGHTS)))))
    ics = F.when(F.size("main") > 0, F.aggregate(covered, F.lit(0.0), lambda s, x: s + x) / F.size("main"))
    support = F.transform("pred", lambda c: _closest(c["bag"], F.col("gt")))
    bad = F.filter(support, lambda b: (F.coalesce(b["s"], F.lit(0.0)) < SIMILAR) & (F.coalesce(b["o"], F.lit(0.0)) < OVERLAPS))
    return g.select(*keys, F.size("main").cast("long").alias("n_chunks"), ics.alias("ics"), F.size("pred").cast("long").alias("n_claims"), F.size(bad).cast("long").alias("n_unsupported"), "n_in", "n_out")


def rouge_l(reference: DataFrame, prediction: DataFrame, by: list[str]) -> DataFrame:
    """(by, lcs, n_ref, n_pred, f1) of stemmed tokens; both sides have one text per group."""
    j = reference.select(*by, F.col("text").alias("ref")).join(prediction.select(*by, F.col("text").alias("pred")), by)

    @F.pandas_udf("struct<lcs long, n_ref long, n_pred long>")
    def measure(ref: pd.Series, pred: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(ref, pred, strict=True):
            x, y = [stem(t) for t in a.split()], [stem(t) for t in b.split()]
            rows.append((lcs(x, y), len(x), len(y)))
        return pd.DataFrame(rows, columns=["lcs", "n_ref", "n_pred"])

    m = j.withColumn("m", measure(normalize(F.col("ref")), normalize(F.col("pred")))).select(*by, "m.*")
    return m.select("*", F.when(F.col("n_ref") + F.col("n_pred") > 0, F.round(2 * F.col("lcs") / (F.col("n_ref") + F.col("n_pred")), 6)).otherwise(F.lit(0.0)).alias("f1"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with bit sets a word long: a row of b's matches for each token of a."""
    at: dict[str, int] = {}
    for i, t in enumerate(b):
        at[t] = at.get(t, 0) | 1 << i
    row = 0
    for t in a:
        x = row | at.get(t, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


# Fixed values of the stemmer: suffixes by step, each with what takes its place, and irregular words.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    k = _shape(word)
    return (k.endswith("cvc") and word[-1] not in "wxy") or k == "vc"


def stem(word: str) -> str:
    """Porter's stemmer in its common extended form, for words over three letters."""
    if len(word) <= 3:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = word
    # Plurals.
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # Past and progressive forms.
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        cut = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), "")
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c":
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _second(w)
    for end, new in _STEP3:
        if w.endswith(end):
            w = w[: -len(end)] + new if _measure(w[: -len(end)]) else w
            break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short(base)):
            w = base
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def _second(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]):
        return _second(w[:-2])
    if w.endswith("logi") and _measure(w[:-3]):
        return w[:-1]
    for end, new in sorted(_STEP2, key=lambda x: -len(x[0])):
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) else w
    return w


def topic_distinctness(spans: DataFrame) -> DataFrame:
    """(meeting_id, topic_id, total_units, unique_units, shared_units) of merged word spans per topic."""
    from convoq.operators.sequence import interval_union

    m = interval_union(spans, ["meeting_id", "topic_id", "speaker"], "s_idx", "e_idx", slack=1)
    # Spans of one topic do not overlap: between two ends the number of open spans is that of topics, and the exclusive or
    # of their hashes is the topic's own where one is open. Words are not made.
    topic = F.xxhash64("topic_id").alias("h")
    ends = m.select("meeting_id", "speaker", topic, F.explode(F.array(F.struct(F.col("s_idx").alias("at"), F.lit(1).alias("d")), F.struct((F.col("e_idx") + 1).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    at = ends.groupBy("meeting_id", "speaker", "x.at").agg(F.sum("x.d").alias("d"), F.bit_xor("h").alias("h"))
    w = Window.partitionBy("meeting_id", "speaker").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    open_ = at.select("meeting_id", (F.lead("at").over(w) - F.col("at")).alias("len"), F.sum("d").over(upto).alias("n"), F.bit_xor("h").over(upto).alias("h"))
    alone = open_.where("n = 1").groupBy("meeting_id", "h").agg(F.sum("len").alias("unique_units"))
    total = m.groupBy("meeting_id", "topic_id").agg(F.sum(F.col("e_idx") - F.col("s_idx") + 1).alias("total_units")).withColumn("h", topic)
    u = F.coalesce("unique_units", F.lit(0).cast("long"))
    return total.join(alone, ["meeting_id", "h"], "left").select("meeting_id", "topic_id", "total_units", u.alias("unique_units"), (F.col("total_units") - u).alias("shared_units"))


def span_text(spans: DataFrame, words: DataFrame, keys: list[str], sep: str = " ") -> DataFrame:
    """(keys, units, length, text) of word spans (speaker, s_idx, e_idx) over words (speaker, pos, word).

    Spans whose start lies after their end or whose ends are no words are left out.
    """
    # Spark takes a split text for one row, so words look small enough to broadcast: the hint shuffles them.
    words = words.hint("merge")
    have = words.select("meeting_id", "speaker", "pos")
    ok = spans.where("s_idx <= e_idx")
    for end in ("s_idx", "e_idx"):
        ok = ok.join(have.withColumnRenamed("pos", end), ["meeting_id", "speaker", end], "left_semi")
    each = ok.select(*keys, "meeting_id", "speaker", "span_idx", F.explode(F.sequence("s_idx", "e_idx")).alias("pos")) if "meeting_id" not in keys else ok.select(*keys, "speaker", "span_idx", F.explode(F.sequence("s_idx", "e_idx")).alias("pos"))
    j = each.join(words.select("meeting_id", "speaker", "pos", "word"), ["meeting_id", "speaker", "pos"])
    part = j.groupBy(*keys, "span_idx", "speaker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_idx", "speaker", "t"))), lambda s: s["t"]), sep)
    g = part.groupBy(*keys).agg(F.count("*").alias("units"), text.alias("text"))
    return g.select(*keys, "units", F.size(F.split("text", " ")).cast("long").alias("length"), "text")
