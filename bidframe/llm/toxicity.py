"""Toxicity scores of text restored by noisy-channel decoding.

Two language models are counted over all documents: letters after two others,
and a table of all words, which grows with the corpus. Words that look
disguised (digits and signs for letters, separators between letters, repeated
letters) become lattices: every sign offers the letters it may stand for, a
separator or a repeated letter may be dropped, each at a price. Viterbi
decoding lists the cheapest readings under the letter model; in runs of spaced
letters it also places word breaks. The readings of the distinct disguised
words are joined with the word table, and the likeliest reading stays, a
word's probability being that of the table mixed with that of its letters.
Disguised words and runs of any length are decoded whole. Words and
restored words give evidence by a lexicon of words and word beginnings, and a
logistic regression turns the strongest evidence into a score.

The lexicon and the regression are fitted on a bounded sample of labelled
rows; language-model counts and scores cover all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidframe.llm._common import written

#: Classes of UTF-8 bytes: 0 no letter, 1 to 26 a to z in either case, 27 part of another letter.
LETTERS = 28
_CLASS = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256)], np.int32)
#: Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e",
}
SEPARATORS = "._-*~/\\' "
SIGN_PRICE, DROP_PRICE, REPEAT_PRICE = 1.0, 0.5, 0.5
STRIP = ".,;:?!\"'()[]{}|*%&#<>=_-~$+"
#: The same without the signs that may stand for letters.
CORE_STRIP = ".,;:?\"'()[]{}*%&#<>=_-~"
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_] ){2,}[^\W_](?!\S)")


#: Readings of a disguised word that the word table chooses from; the weight of the table against the letters.
READINGS, TABLE_WEIGHT = 4, 0.5
#: What the scan of the corpus counts: letters after two others, words, disguised words.
LETTER, WORD, ODD = 0, 1, 2


def odd_words(tokens: Iterable[str]) -> tuple[set[str], set[str]]:
    """Stripped words of lower-case tokens, and those that look disguised."""
    found, odd = set(), set()
    for token in set(tokens):
        w = token.strip(STRIP)
        found.add(w)
        if w.isalpha():
            if len(w) > 3 and _TRIPLE.search(w):
                odd.add(w)
            if len(w) == len(token):
                continue
        core = token.strip(CORE_STRIP)
        if len(core) != len(w) or not w.isalpha():
            if not core.isalpha() and any(map(str.isalpha, core)):
                odd.add(core)
    found.discard("")
    return found, odd


def spaced_runs(tokens: list[str]) -> set[str]:
    """Runs of three single letters and more."""
    if sum(len(w) == 1 for w in tokens) < 3:
        return set()
    return {m.group() for m in _SPACED.finditer(" ".join(tokens))}


def _letter_counts(texts: Iterable[bytes]) -> np.ndarray:
    """Counts of letter classes after two others; texts are counted together, a few million bytes at a time."""
    counts = np.zeros(LETTERS**3, np.int64)
    held, size = [], 0
    for text in [*texts, None]:
        if text is not None:
            held += (b"  ", text)
            size += len(text)
        if held and (text is None or size > 1 << 21):
            c = _CLASS[np.frombuffer(b"".join(held) + b" ", np.uint8)]
            counts += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
            held, size = [], 0
    return counts


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        tokens: Counter = Counter()
        odd: set[str] = set()
        texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
        letters += _letter_counts(texts)
        for data in texts:
            own = data.decode().lower().split()
            tokens.update(own)
            odd |= spaced_runs(own)
        odd |= odd_words(tokens)[1]
        words: dict[str, int] = {}
        for token, n in tokens.items():
            w = token.strip(STRIP)
            if w.isalpha():
                words[w] = words.get(w, 0) + n
        keys = [*words, *odd]
        yield pa.RecordBatch.from_arrays([
            pa.array([WORD] * len(words) + [ODD] * len(odd), pa.int32()), pa.array(keys, pa.string()), pa.array([*words.values(), *[1] * len(odd)], pa.int64())], ["kind", "key", "n"])
    at = np.nonzero(letters)[0]
    yield pa.RecordBatch.from_arrays([pa.array([LETTER] * len(at), pa.int32()), pa.array(map(str, at.tolist()), pa.string()), pa.array(letters[at], pa.int64())], ["kind", "key", "n"])


def scanned(docs: DataFrame) -> DataFrame:
    """``kind, key, n`` over all documents: letter classes after two others, words, disguised words and runs; written."""
    rows = docs.select("text").mapInArrow(_scan, "kind int, key string, n long")
    return written(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")), "scan", "kind")


def letter_model(scan: DataFrame) -> np.ndarray:
    """Log probability of a letter class after two others. At most 28^3 counts reach the driver."""
    counts = np.full(LETTERS**3, 0.1)
    for r in scan.where(F.col("kind") == LETTER).collect():
        counts[int(r.key)] += r.n
    counts = counts.reshape(LETTERS, LETTERS, LETTERS)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def language_model(docs: DataFrame) -> np.ndarray:
    """The letter model of ``docs``."""
    return letter_model(scanned(docs))


def _options(token: str, i: int) -> list[tuple[str, float]]:
    c = token[i]
    if c in SIGNS:
        found = [(x, SIGN_PRICE) for x in SIGNS[c]]
        if i + 1 == len(token) and c in "!|+(":
            found.append(("", 0.0))
    elif c in SEPARATORS:
        return [("", DROP_PRICE)]
    elif c.isalpha():
        found = [(c, 0.0)]
    else:
        return [("", 2 * DROP_PRICE)]
    if i and token[i - 1] == c:
        found.append(("", REPEAT_PRICE))
    return found


def readings(token: str, model: list, breaks: bool = False, most: int = READINGS) -> list[tuple[float, float, str]]:
    """The ``most`` likeliest readings of a lower-case token, best first: price of the changes, letters' negative log probability, reading.

    Viterbi over states of the last two letter classes; a state keeps its
    ``most`` best readings, which are linked backwards, so that time and memory
    grow with the token's length. With ``breaks`` a space of the token may also
    end a word.
    """

    def of(x: str) -> int:
        return 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else 27

    states: dict[tuple[int, int], list[tuple[float, float, int, tuple | None]]] = {(0, 0): [(0.0, 0.0, 0, None)]}
    for i in range(len(token)):
        options = _options(token, i)
        if breaks and token[i] == " ":
            options.append((" ", DROP_PRICE))
        new: dict[tuple[int, int], list] = {}
        for (a, b), held in states.items():
            for letter, extra in options:
                if letter:
                    c = of(letter)
                    cost = extra - model[a][b][c]
                    new.setdefault((b, c), []).extend((total + cost, price + extra, hash((mark, letter)), (letter, read)) for total, price, mark, read in held)
                else:
                    new.setdefault((a, b), []).extend((total + extra, price + extra, mark, read) for total, price, mark, read in held)
        for state, held in new.items():
            if len(held) > 1:  # of equal readings the cheapest stays
                held.sort(key=lambda x: x[0])
                seen: set[int] = set()
                new[state] = [x for x in held if not (x[2] in seen or seen.add(x[2]))][:most]
        states = new
    ends = sorted(((total - model[a][b][0], price, mark, read) for (a, b), held in states.items() for total, price, mark, read in held), key=lambda x: x[0])
    out, seen = [], set()
    for total, price, mark, read in ends:
        if mark not in seen:
            seen.add(mark)
            letters = []
            while read:
                letters.append(read[0])
                read = read[1]
            out.append((price, total - price, "".join(reversed(letters))))
            if len(out) == most:
                break
    return out


def decode(token: str, model: list, breaks: bool = False) -> str:
    """The likeliest reading of a token by the letter model alone."""
    return readings(token, model, breaks, 1)[0][2]


class Reader:
    """Words of a text together with the readings of its disguised words by the letter model alone."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()

    def words(self, text: str) -> set[str]:
        tokens = text.lower().split()
        found, odd = odd_words(tokens)
        for run in spaced_runs(tokens):
            found.update(decode(run, self.model, True).split())
            odd.add(run)
        found.update(decode(w, self.model) for w in odd)
        found.discard("")
        return found


def _readings(model: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.tolist()
        for batch in batches:
            rows = []
            for token in batch.column("key").to_pylist():
                for part, breaks in enumerate((False, True) if " " in token else (False,)):
                    for number, (price, cost, reading) in enumerate(readings(token, table, breaks)):
                        for word in dict.fromkeys(reading.split()):
                            rows.append((token, part, number, price, cost, word, -readings_cost(word, table)))
            columns = list(zip(*rows)) or [[]] * 7
            types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["token", "part", "number", "price", "cost", "word", "letters"])

    return work


def readings_cost(word: str, model: list) -> float:
    """Negative log probability of a word's letters and its end."""
    a = b = 0
    total = 0.0
    for x in word:
        c = ord(x) - 96 if "a" <= x <= "z" else 27
        total -= model[a][b][c]
        a, b = b, c
    return total - model[a][b][0]


def restored(scan: DataFrame, model: np.ndarray) -> DataFrame:
    """``token, word``: the words of the likeliest reading of each disguised word and run, written.

    A reading costs its changes and, for each of its words, the negative log
    of the word's probability: its share of all words counted, mixed with the
    probability of its letters. The table of words grows with the corpus and is
    joined, not shipped.
    """
    words = scan.where(F.col("kind") == WORD).select(F.col("key").alias("word"), F.col("n"))
    total = words.agg(F.sum("n")).first()[0] or 1
    found = written(scan.where(F.col("kind") == ODD).select("key").repartition("key").mapInArrow(
        _readings(model), "token string, part int, number int, price double, cost double, word string, letters double"), "readings")
    known = found.join(words.hint("merge"), "word", "left")
    likely = F.coalesce("n", F.lit(0)) * F.lit(TABLE_WEIGHT / total) + (1 - TABLE_WEIGHT) * F.exp("letters")
    cost = known.groupBy("token", "part", "number").agg((F.first("price") - F.sum(F.log(likely + F.lit(1e-300)))).alias("cost"), F.collect_list("word").alias("words"))
    best = cost.groupBy("token", "part").agg(F.min_by("words", F.struct("cost", "number")).alias("words"))
    return written(best.select("token", F.explode("words").alias("word")).distinct(), "restored")


def features(word: str) -> list[str]:
    """The word, marked, and its beginnings of three to six letters."""
    return [f"={word}", *(word[:k] for k in (3, 4, 5, 6) if len(word) >= k)]


def _with_readings(rows: DataFrame, odd: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (key ``row``) with ``restored``: the words restored from their disguised ones. ``odd``: row, token."""
    words = odd.join(found.hint("merge"), "token").groupBy(F.col("row").alias("of_row")).agg(F.collect_set("word").alias("restored"))
    return rows.join(words.hint("merge"), F.col("row") == F.col("of_row"), "left").drop("of_row")


def _disguised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, token`` of each row's disguised words and runs."""
    for batch in batches:
        rows = []
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
            tokens = (text or "").lower().split()
            rows += [(row, t) for t in odd_words(tokens)[1] | spaced_runs(tokens)]
        columns = list(zip(*rows)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["row", "token"])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, more, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "restored", "toxic"))):
            words = odd_words((text or "").lower().split())[0] | set(more or ())
            counts[toxic].update({f for w in words for f in features(w)})
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([
            pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64()),
        ], ["feature", "toxic", "clean"])


def word_weight(word: str, lexicon: dict[str, float]) -> float:
    return max((lexicon.get(f, 0.0) for f in features(word)), default=0.0)


def evidence(weights: list[float], words: int) -> list[float]:
    """The three largest word weights, the number of words with weight, and that number's share of ``words``."""
    weights = sorted(weights, reverse=True)
    top = [*weights[:3], 0.0, 0.0, 0.0][:3]
    return [*top, math.log1p(len(weights)), len(weights) / math.sqrt(words + 1)]


def _weighted(lexicon: dict[str, float]):
    """Of each row its words with weight, the number of its words, and its disguised ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            heavy, sizes, odd = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = (text or "").lower().split()
                found, disguised = odd_words(tokens)
                own = []
                for w in found:
                    weight = known.get(w)
                    if weight is None:
                        weight = word_weight(w, lexicon)
                        if len(known) < 500_000:
                            known[w] = weight
                    if weight:
                        own.append(w)
                heavy.append(own)
                sizes.append(len(found))
                odd.append(list(disguised | spaced_runs(tokens)))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(heavy, pa.list_(pa.string())), pa.array(sizes, pa.int64()), pa.array(odd, pa.list_(pa.string()))], [*names, "heavy", "words", "odd"])

    return work


def _scores(lexicon: dict[str, float], weights: list[float] | None = None, bias: float = 0.0):
    """Of each row its evidence or, with ``weights``, its score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own, more, n in zip(*(batch.column(c).to_pylist() for c in ("heavy", "restored", "words"))):
                more = set(more or ())
                found.append(evidence([w for w in (word_weight(x, lexicon) for x in more | set(own)) if w], n + len(more)))
            names = [c for c in batch.schema.names if c not in ("heavy", "restored", "words")]
            if weights is None:
                last, name = pa.array(found, pa.list_(pa.float64())), "evidence"
            else:
                z = np.array(found, float).reshape(-1, len(weights)) @ np.array(weights) + bias
                last, name = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64()), "score"
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), last], [*names, name])

    return work


def _read(rows: DataFrame, lexicon: dict[str, float], found: DataFrame) -> DataFrame:
    """``rows`` (key ``row``) without ``text``, with ``heavy``, ``words`` and ``restored``."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", heavy array<string>, words long, odd array<string>"
    read = written(rows.mapInArrow(_weighted(lexicon), schema), "read")
    return _with_readings(read.drop("odd"), read.select("row", F.explode("odd").alias("token")), found)


def _fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


class ToxicityModel:
    """Readings of the corpus' disguised words, lexicon and regression; ``score`` applies them to the documents they were fitted with."""

    def __init__(self, found: DataFrame, lexicon: dict[str, float], weights: list[float], bias: float) -> None:
        self.found, self.lexicon, self.weights, self.bias = found, lexicon, weights, bias

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id, text_key, score`` for each row of ``docs``: 0 to 1, higher for likelier toxic. ``text_key`` is a hash of the text."""
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))
        read = _read(rows, self.lexicon, self.found).select("doc_id", "text_key", "heavy", "words", "restored")
        return read.mapInArrow(_scores(self.lexicon, self.weights, self.bias), "doc_id long, text_key long, score double")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> ToxicityModel:
    """Fit on at most ``sample`` labelled documents with ``crc32(doc_id) mod 5`` not 0, chosen by a hash of the id.

    Remainders 1 to 3 give the lexicon (document frequencies of words and word
    beginnings by label; those with a lower bound of the log odds above 1
    stay, at most as many as the sample's words), remainder 4 the regression.
    Labels other than 0 and 1 and null ids are ignored; a document with both
    labels counts as toxic. Without both labels the scores are constant.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    scan = scanned(docs)
    found = restored(scan, letter_model(scan))
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(_fold("doc_id") != 0)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    chosen = written(chosen, "chosen")  # at most ``sample`` rows of 12 bytes: the broadcast is bounded
    rows = written(docs.join(F.broadcast(chosen), "doc_id").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "toxic").repartition(F.col("doc_id")), "sample")
    fitting, calibrating = rows.where(_fold("doc_id") != 4), rows.where(_fold("doc_id") == 4)
    n = {r.toxic: r["count"] for r in fitting.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(found, {}, [0.0] * 5, 0.0 if toxic == clean else 5.0 if toxic else -5.0)
    odd = fitting.select("row", "text").mapInArrow(_disguised, "row long, token string")
    counts = _with_readings(fitting.select("row", "text", "toxic"), odd, found).select("text", "restored", "toxic").mapInArrow(_feature_counts, "feature string, toxic long, clean long")
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(t / F.lit(toxic + 1.0)) - F.log(c / F.lit(clean + 1.0)) - F.sqrt(1 / t + 1 / c)
    kept = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3").select("feature", weight.alias("weight")).where("weight > 1")
    lexicon = {r.feature: r.weight for r in kept.collect()}  # the sample bounds it
    read = _read(calibrating.select("row", "toxic", "text"), lexicon, found).select("toxic", "heavy", "words", "restored")
    seen = written(read.mapInArrow(_scores(lexicon), "toxic int, evidence array<double>"), "evidence")
    if seen.select("toxic").distinct().count() < 2:
        return ToxicityModel(found, lexicon, [1.0, 0.5, 0.5, 0.0, 0.0], -5.0)
    fitted = LogisticRegression(featuresCol="x", labelCol="toxic", regParam=0.001, maxIter=60).fit(seen.select("toxic", array_to_vector("evidence").alias("x")))
    return ToxicityModel(found, lexicon, [float(w) for w in fitted.coefficients], float(fitted.intercept))


def score_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    ``held_out`` rows (``crc32(doc_id) mod 5`` is 0; null ids are not) take no
    part in fitting. Null texts score as empty ones; repeated rows score alike;
    texts of any length are read whole. Other columns of ``docs``, of any name,
    are ignored. No rows give no rows.
    """
    scored = fit(docs, labels, **settings).score(docs)
    return scored.select("doc_id", F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, whatever their names.

    Null, empty and very long texts, repeated rows and empty tables are treated
    as in ``score_documents``; rows are told apart by id and text.
    """
    gone = fit(docs, labels, **settings).score(docs).where(F.col("score") >= threshold).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    gone = written(gone, "toxic").hint("merge")
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.gone_id) & (F.xxhash64(docs.text) == gone.gone_key), "left_anti")
