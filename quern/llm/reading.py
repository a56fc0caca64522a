"""Reading level: how much vocabulary a text asks for, and how complex its sentences are.

A document's *coverage rank* is the size of the smallest vocabulary, taken by
frequency in the document's language, that covers a fixed share of its words. With
words to a sentence and letters to a word it is calibrated in SQL against reading
bands that readers gave to a sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.session import materialise, spread

#: Shares of a document's words that the vocabulary has to cover.
SHARES = (0.90, 0.95)
#: Words of running prose from which a document has a reading level.
LEAST_WORDS = 30
#: Words by language that are sent to all tasks. A document that they don't cover gets
#: its ranks from the whole vocabulary by a join, so the bound changes no rank. A
#: document's language is judged by these words alone: a fit of bounded size.
HEAD = 50_000
#: Labelled documents the calibration is fitted on at most, chosen by the hash of their id.
SAMPLE = 200_000
#: Bands of a language that fewer labelled documents than this have are calibrated over all languages.
LEAST_LABELS = 3
#: Labels of a band that agree with the fit before, from which its features are taken for correlated; and how often that is fitted again.
LEAST_AGREEING, REFITS = 15, 3
#: The least spread of a feature, in logarithms.
LEAST_SPREAD = 0.05
BANDS = (1, 2, 3, 4)
#: How languages are written, by two-letter code.
LANGUAGES = {"en": ("en", "eng"), "vi": ("vi", "vie"), "de": ("de", "deu", "ger"), "fr": ("fr", "fra", "fre")}
FEATURES = ("rank_0", "rank_1", "sentence", "letters")

#: Stands for a rank that isn't known.
_UNKNOWN = np.iinfo(np.int64).max

_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_ITEM = re.compile(r"(?:[-*+•]|\d+[.)])\s+")
_HEADING = re.compile(r"#{1,6}(?:\s|$)")
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}'’‐‑-]*").findall
_SENTENCES = re.compile(r"(?<=[.!?;:])\s+")


def prose(text: str) -> list[str]:
    """The paragraphs and list items of a text, each in one line, without tables, fenced code and headings."""
    parts, open_fence, current = [], "", []
    for line in re.split(r"\r\n|\n|\r", text):
        bare = line.strip()
        fence = _FENCE.match(line)
        if open_fence:
            if fence and fence[1].startswith(open_fence) and bare == fence[1]:
                open_fence = ""
            continue
        item = _ITEM.match(bare)
        ends = not bare or fence or item or bare[0] == "|" or _HEADING.match(bare)
        if ends and current:
            parts.append(" ".join(current))
            current = []
        if fence:
            open_fence = fence[1]
        elif item:
            current = [bare[item.end() :]]
        elif not ends:
            current.append(bare)
    if current:
        parts.append(" ".join(current))
    return parts


def profile_text(text: str | None) -> tuple[Counter, int, int]:
    """Words of the prose with their counts, sentences, and letters."""
    words: Counter = Counter()
    sentences = letters = 0
    for part in prose(text or ""):
        for sentence in _SENTENCES.split(part):
            found = _WORDS(sentence)
            if found:
                sentences += 1
                words.update(w.lower() for w in found)
                letters += sum(map(len, found))
    return words, sentences, letters


def profiles(documents: DataFrame) -> DataFrame:
    """``doc_id, declared, n_words, sentences, letters, words, counts`` of documents with enough running prose.

    ``declared`` is the language the row names, as a two-letter code, or null.
    """
    code = F.lower(F.regexp_extract(F.trim("lang"), r"^([A-Za-z]+)", 1))
    declared = F.coalesce(*[F.when(code.isin(*names), F.lit(short)) for short, names in LANGUAGES.items()])
    schema = T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL("declared string, n_words long, sentences long, letters long, words array<string>, counts array<long>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words, sentences, letters = profile_text(text)
                total = words.total()
                if total >= LEAST_WORDS:
                    kept.append(i)
                    rows.append((total, sentences, letters, list(words), list(words.values())))
            own = batch.take(pa.array(kept, pa.int64()))
            columns = [list(c) for c in zip(*rows)] or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("declared"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return spread(documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", declared.alias("declared"), "text")).mapInArrow(run, schema)


def _word_counts(profile: DataFrame, language: str) -> DataFrame:
    """``language, word, n`` over all documents of a known language."""
    pairs = profile.where(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.explode(F.arrays_zip("words", "counts")).alias("e"))
    return pairs.groupBy("language", F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("n"))


def with_ranks(counts: DataFrame) -> DataFrame:
    """``language, word, n, rank``: the rank is the number of words at least as frequent, so ties share it.

    Needs no sort of the vocabulary: it adds up how many words have each count.
    """
    by_count = counts.groupBy("language", "n").agg(F.count("*").alias("words"))
    above = F.sum("words").over(Window.partitionBy("language").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    ranks = by_count.select("language", "n", above.alias("rank"))
    return counts.join(ranks, ["language", "n"]).select("language", "word", "n", "rank")


def _head(ranked: DataFrame, head: int) -> dict[str, dict[str, tuple[int, int]]]:
    """``language -> word -> (n, rank)`` of the most frequent words: at most ``head`` a language."""
    found: dict[str, dict[str, tuple[int, int]]] = {}
    for row in ranked.where(F.col("rank") <= head).collect():
        found.setdefault(row["language"], {})[row["word"]] = (row["n"], row["rank"])
    return found


def with_language(profile: DataFrame, head: int = HEAD) -> DataFrame:
    """Adds ``language``: the one whose word frequencies fit the document best.

    Frequencies come from the documents that declare a language; what a single row
    declares, wrongly or not, does not decide its own. Without any declaration all
    documents are of one unknown language. Only the ``head`` most frequent words of
    each language are compared; all others count alike for every language.
    """
    known = _head(with_ranks(_word_counts(profile, "declared")), head)
    codes = sorted(known)
    place = {word: i for i, word in enumerate(sorted(set().union(*known.values())))}
    totals = np.array([sum(n for n, _ in known[c].values()) for c in codes]) + 1000.0
    counts = np.full((len(place) + 1, len(codes)), 0.1)
    for k, code in enumerate(codes):
        for word, (n, _) in known[code].items():
            counts[place[word], k] += n
    sent = profile.sparkSession.sparkContext.broadcast((codes or ["und"], pa.array(place, pa.string()), np.log(counts / totals) if codes else np.zeros((1, 1))))
    schema = T.StructType([profile.schema["doc_id"], T.StructField("language", T.StringType()), *[profile.schema[c] for c in ("n_words", "sentences", "letters", "words", "counts")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, vocabulary, logs = sent.value
        for batch in batches:
            at, n, starts = _words(batch, vocabulary)
            scores = np.add.reduceat(logs[at] * n[:, None], starts) if len(starts) else np.zeros((0, len(codes)))
            best = np.array(codes, object)[scores.argmax(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(best, pa.string()), *(batch.column(c) for c in schema.names[2:])], names=schema.names
            )

    return profile.mapInArrow(run, schema)


def _words(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch's rows end to end: place in the vocabulary (its size if absent), count, and where each row starts.

    Every row has words.
    """
    words, counts = batch.column("words"), batch.column("counts")
    at = pc.fill_null(pc.index_in(words.flatten(), value_set=vocabulary), len(vocabulary)).to_numpy(zero_copy_only=False)
    starts = np.diff(words.offsets.to_numpy()).cumsum()
    return at, counts.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], starts[:-1]]).astype(np.int64) if len(starts) else starts


def coverage_ranks(ranks: np.ndarray, counts: np.ndarray, starts: np.ndarray, shares: tuple[float, ...]) -> list[np.ndarray]:
    """For each share and row, the least rank up to which the row's words make it up.

    ``ranks`` and ``counts`` hold the words of all rows end to end. A rank of the
    greatest integer stands for a word of unknown rank, and comes out where the known ones don't suffice.
    """
    if not len(starts):
        return [np.zeros(0, np.int64) for _ in shares]
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ranks))))
    order = np.lexsort((ranks, row))
    ranks, counts = ranks[order], counts[order]
    totals = np.add.reduceat(counts, starts)
    covered = counts.cumsum() - np.repeat(np.append(0, totals.cumsum()[:-1]), np.diff(np.append(starts, len(ranks))))
    out = []
    for share in shares:
        enough = covered >= (share * totals)[row]
        out.append(np.minimum.reduceat(np.where(enough, ranks, _UNKNOWN), starts))
    return out


def coverage(profile: DataFrame, head: int = HEAD, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """Adds the coverage ranks ``rank_0``, ``rank_1``, ... to profiles with a language.

    Documents that the most frequent words cover are done where they are; the rest
    joins the whole vocabulary, which gives the same ranks.
    """
    ranked = materialise(with_ranks(_word_counts(profile, "language")), "ranks")
    known = _head(ranked, head)
    place = {word: i for i, word in enumerate(sorted(set().union(*known.values())))}
    codes = {code: k for k, code in enumerate(sorted(known))}
    table = np.full((max(1, len(codes)), len(place) + 1), _UNKNOWN)
    for code, words in known.items():
        for word, (_, rank) in words.items():
            table[codes[code], place[word]] = rank
    sent = profile.sparkSession.sparkContext.broadcast((codes, pa.array(place, pa.string()), table))
    names = [f"rank_{i}" for i in range(len(shares))]
    kept = ["doc_id", "language", "n_words", "sentences", "letters"]
    schema = T.StructType([*(profile.schema[c] for c in kept), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, vocabulary, table = sent.value
        for batch in batches:
            at, n, starts = _words(batch, vocabulary)
            language = np.array([codes.get(c, 0) for c in batch.column("language").to_pylist()], np.int64)
            sizes = np.diff(np.append(starts, len(at)))
            found = coverage_ranks(table[np.repeat(language, sizes), at], n, starts, shares)
            columns = [pa.array(r, pa.int64(), mask=r == _UNKNOWN) for r in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=schema.names)

    done = materialise(profile.mapInArrow(run, schema), "coverage")
    missing = F.greatest(*[F.col(n).isNull() for n in names])
    rest = profile.join(done.where(missing).select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_text", F.xxhash64("words", "counts"))
    pairs = rest.dropDuplicates([*kept, "_text"]).select(*kept, "_text", F.explode(F.arrays_zip("words", "counts")).alias("e")).select(*kept, "_text", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    met = pairs.join(ranked.select("language", "word", "rank"), ["language", "word"])
    by_rank = F.sort_array(F.collect_list(F.struct("rank", "n")))
    steps = met.groupBy(*kept, "_text").agg(by_rank.alias("r"))

    def reached(share: float):
        begun = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("rank"))

        def step(sums, x):
            n = sums["n"] + x["n"]
            return F.struct(n.alias("n"), F.when(sums["rank"].isNull() & (n >= F.lit(share) * F.col("n_words")), x["rank"].cast("long")).otherwise(sums["rank"]).alias("rank"))

        return F.aggregate("r", begun, step)["rank"]

    far = steps.select(*kept, *[reached(s).cast("long").alias(n) for s, n in zip(shares, names)])
    return done.where(~missing).unionByName(far)


def features(covered: DataFrame) -> DataFrame:
    """``doc_id, language`` and the logarithms of the coverage ranks, words a sentence and letters a word."""
    logs = {"rank_0": F.log("rank_0"), "rank_1": F.log("rank_1"), "sentence": F.log(F.col("n_words") / F.col("sentences")), "letters": F.log(F.col("letters") / F.col("n_words")) * 2}
    return covered.select("doc_id", "language", *[e.alias(n) for n, e in logs.items()])


def majority_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, reading_band``: the band most labels of a document give, the plainer of equals; no others count."""
    votes = labels.where(F.col("reading_band").isin(*BANDS) & F.col("doc_id").isNotNull()).groupBy("doc_id", "reading_band").agg(F.countDistinct("labeller").alias("n"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("reading_band")).alias("least"))).alias("b")).select("doc_id", (-F.col("b.least")).alias("reading_band"))
    return best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def calibrate(described: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``language, cells``: for each band its number, the middle of its features, their precision and a constant.

    First each band's features are fitted one by one by medians, which wrong labels
    hardly move. Then, a few times, labels that disagree with the fit are left out and
    means and covariances are fitted to the rest. All statistics are taken in SQL; the
    driver gets a row for each language and band and inverts matrices of four by four.
    Bands with too few labels in a language take the figures over all languages, and a
    band nobody gave is absent.
    """
    known = materialise(described.join(majority_labels(labels, sample), "doc_id"), "labelled")

    def medians(by: list[str]) -> DataFrame:
        middle = known.groupBy(*by).agg(F.count("*").alias("n"), *[F.median(f).alias(f"{f}_m") for f in FEATURES])
        off = known.join(F.broadcast(middle), by).groupBy(*by).agg(*[F.median(F.abs(F.col(f) - F.col(f"{f}_m"))).alias(f"{f}_s") for f in FEATURES])
        widths = [F.greatest(F.col(f"{f}_s") * 1.4826, F.lit(LEAST_SPREAD)).alias(f"{f}_s") for f in FEATURES]
        return middle.join(off, by).select(*by, "n", *[f"{f}_m" for f in FEATURES], *widths)

    own = {(r["language"], r["reading_band"]): r for r in medians(["language", "reading_band"]).where(F.col("n") >= LEAST_LABELS).collect()}
    pooled = {r["reading_band"]: r for r in medians(["reading_band"]).collect()}
    spoken = sorted(r["language"] for r in described.select("language").distinct().collect())
    first: dict[str, list[tuple]] = {}
    for language in spoken:
        for band in sorted(pooled):
            row = own.get((language, band), pooled[band])
            first.setdefault(language, []).append(_cell(band, [row[f"{f}_m"] for f in FEATURES], np.diag([row[f"{f}_s"] ** 2 for f in FEATURES])))

    spark, fit = described.sparkSession, first
    pairs = [(a, b) for a in range(len(FEATURES)) for b in range(a, len(FEATURES))]
    for _ in range(REFITS):
        agreed = nearest_band(known, _cells(spark, fit), ["reading_band"]).where("band = reading_band")
        sums = agreed.groupBy("language", "reading_band").agg(
            F.count("*").alias("n"), *[F.avg(f).alias(f"m{a}") for a, f in enumerate(FEATURES)], *[F.covar_pop(FEATURES[a], FEATURES[b]).alias(f"c{a}{b}") for a, b in pairs]
        )
        bands: dict[str, dict[int, tuple]] = {}
        for r in sums.where(F.col("n") >= LEAST_AGREEING).collect():
            covariance = np.eye(len(FEATURES)) * (LEAST_SPREAD / 2) ** 2
            for a, b in pairs:
                covariance[a, b] += r[f"c{a}{b}"]
            covariance = np.triu(covariance) + np.triu(covariance, 1).T
            bands.setdefault(r["language"], {})[r["reading_band"]] = _cell(r["reading_band"], [r[f"m{a}"] for a in range(len(FEATURES))], covariance)
        # a language is refitted as a whole or not at all, so that its bands stay comparable
        fit = {code: list(bands[code].values()) if len(bands.get(code, {})) == len(cells) else cells for code, cells in first.items()}
    return _cells(spark, fit)


def _cell(band: int, middle: list[float], covariance: np.ndarray) -> tuple:
    return band, [float(m) for m in middle], [float(x) for x in np.linalg.inv(covariance).ravel()], float(np.linalg.slogdet(covariance)[1])


def _cells(spark, by_language: dict[str, list[tuple]]) -> DataFrame:
    schema = "language string, cells array<struct<band: int, middle: array<double>, precision: array<double>, constant: double>>"
    return spark.createDataFrame(list(by_language.items()), schema)


def nearest_band(described: DataFrame, cells: DataFrame, also: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds ``band``, the likeliest one; the plainer of equals. ``cells`` has a row a language."""
    size = len(FEATURES)

    def distance(c):
        off = [F.col(f) - c["middle"][a] for a, f in enumerate(FEATURES)]
        terms = [off[a] * off[b] * c["precision"][a * size + b] for a in range(size) for b in range(size)]
        return sum(terms[1:], terms[0]) + c["constant"]

    nearest = F.array_min(F.transform("cells", lambda c: F.struct(distance(c).alias("d"), c["band"].alias("band"))))["band"]
    return described.join(F.broadcast(cells), "language").select("doc_id", "language", *also, *FEATURES, nearest.alias("band"))


def reading_bands(documents: DataFrame, labels: DataFrame, head: int = HEAD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, reading_band`` of every document with enough running prose: the likeliest band.

    Null, empty and short texts, and texts of tables, code and headings only, have no
    band and don't come out. The row's own label is one of the sample, no more.
    Repeated documents come out once (of different texts under one id, the lower
    band). Ties go to the plainer band. Without any label nothing comes out. Other columns are ignored.
    """
    profile = materialise(profiles(documents), "profiles")
    spoken = materialise(with_language(profile, head), "languages")
    described = materialise(features(coverage(spoken, head)), "features")
    bands = nearest_band(described, calibrate(described, labels, sample))
    return bands.where("band IS NOT NULL").groupBy("doc_id").agg(F.min("band").alias("reading_band"))
