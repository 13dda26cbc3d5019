"""Language identification by mixtures: what share of a document is in which language.

Every labelled document is counted into character n-grams of its language (orders 1 to 3 of
lower-cased words, with a mark at both ends; interpolated).  A document is a mixture of languages:
each of its words comes from one of them, with a likelihood given by the word's n-grams.
Expectation-maximisation finds the proportions.  The set of languages grows along these
proportions as long as the log-likelihood rises by more than a penalty, which is the logarithm of the number of words
times ``PENALTY`` and a small cost a word, since words of one language now and then look like
another.  The predicted language is the one with the largest share in the chosen set.

Text is read twice, once to count and once to predict.  n-grams share ``BUCKETS`` hashed places a language; the
counts are summed by Spark and the table of probabilities, at most ``MODEL_ENTRIES`` numbers
whatever the corpus, goes to the tasks.  With more than ``MODEL_ENTRIES / BUCKETS`` languages each has
fewer places, and over ``MOST_LANGUAGES`` values of ``lang`` raise an error.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and no languages, and
so is every text if nothing was learned; a null ``lang`` is not learned from; a null id counts as the empty text where
ids are dealt out (so it is learned from); repeated rows count as often as they come; ties go to the
language that was seen more often, then to the first by code point; letters that no language was seen with are equally
likely in all.  Extra columns are ignored.  Runs of more than ``PIECE`` letters are cut, so texts
without blanks are mixtures as well.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import only, slices

UNKNOWN = "und"
BUCKETS = 1 << 16
MODEL_ENTRIES = 1 << 22
MOST_LANGUAGES = 1 << 14
#: Letters of a word that are looked at as one unit.
PIECE = 24
#: Pseudo-counts with which a longer n-gram leans on the next shorter one.
LEAN = 8.0
#: Cost of one more language: times log(words), and per word.
PENALTY = 2.0
WORD_COST = 0.02
ROUNDS = 30
CLOSE = 1e-4
HELD_OUT = 2
#: Shares and scores are rounded, so that they do not tell how the rows lay.
DIGITS = 6
PART_BYTES = 4 << 20
BLANK = np.uint64(32)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: a quarter of the ids."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == HELD_OUT


# ---- words and n-grams -----------------------------------------------------------------


class Words(NamedTuple):
    """Words of a batch: the distinct ones, and for each (document, word) how often it comes."""

    distinct: pa.Array
    doc: np.ndarray
    word: np.ndarray
    count: np.ndarray


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``starts`` and are ``sizes`` long, one run after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def words_of(texts: pa.Array) -> Words:
    """Words are runs of letters, and marks on them, in lower case, cut at ``PIECE``.  Documents are in rising order;
    a token between blanks is cut into words once, however often it comes."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = pc.dictionary_encode(lists.flatten())
    doc = np.repeat(np.arange(len(lengths)), lengths)
    n_tokens = max(1, len(encoded.dictionary))
    pairs, count = np.unique(doc * n_tokens + encoded.indices.to_numpy(), return_counts=True)
    doc, token = np.divmod(pairs, n_tokens)
    spaced = pc.replace_substring_regex(pc.utf8_lower(encoded.dictionary), pattern=r"[^\pL\pM]+", replacement=" ")
    runs = pc.split_pattern(spaced, " ")
    sizes = pc.list_value_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.dictionary_encode(runs.flatten())
    starts = np.cumsum(sizes) - sizes
    word = found.indices.to_numpy()[_runs(starts[token], sizes[token])]
    doc, count = np.repeat(doc, sizes[token]), np.repeat(count, sizes[token])
    return _cut(found.dictionary, doc, word, count)


def _cut(distinct: pa.Array, doc: np.ndarray, word: np.ndarray, count: np.ndarray) -> Words:
    """Drop what holds no letter and cut what is longer than ``PIECE``."""
    lettered = pc.match_substring_regex(distinct, r"\pL").to_numpy(zero_copy_only=False)
    long = np.flatnonzero(lettered & (pc.utf8_length(distinct).to_numpy(zero_copy_only=False) > PIECE))
    sizes, starts = lettered.astype(np.int64), np.arange(len(distinct))
    cuts = []
    for k in long:
        whole = distinct[k].as_py()
        starts[k] = len(distinct) + len(cuts)
        cuts += [whole[at : at + PIECE] for at in range(0, len(whole), PIECE)]
        sizes[k] = len(distinct) + len(cuts) - starts[k]
    if cuts:
        distinct = pa.concat_arrays([distinct, pa.array(cuts, distinct.type)])
    times = sizes[word]
    return Words(distinct, np.repeat(doc, times), _runs(starts[word], times), np.repeat(count, times))


def _place(a: np.ndarray, b: np.ndarray, c: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Hashed place of an n-gram, given the codes of its last three characters."""
    with np.errstate(over="ignore"):
        h = np.uint64(order + 1) * np.uint64(0x9E3779B97F4A7C15)
        for part in (a, b, c):
            h = (h ^ part) * np.uint64(0xFF51AFD7ED558CCD)
            h = h ^ (h >> np.uint64(29))
        return ((h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(40)).astype(np.int64) % buckets


def ngram_places(words: pa.Array, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of the n-grams of orders 3, 2 and 1 and of the contexts of orders 3 and 2, a row each character of
    each word and one for its end; and the word each row belongs to."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    text = pa.large_string()
    ended = pc.binary_join_element_wise(words.cast(text), pa.scalar("", text), pa.scalar(" ", text))
    together = ended.buffers()[2].to_pybytes().decode() if len(words) else ""
    codes = np.frombuffer(f" {together}".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c, b = codes[1:], codes[:-1]
    a = np.concatenate(([BLANK], b[:-1]))
    a = np.where(b == BLANK, BLANK, a)  # a word does not see the one before it
    zero = np.zeros_like(c)
    places = [
        _place(a, b, c, 3, buckets), _place(zero, b, c, 2, buckets), _place(zero, zero, c, 1, buckets),
        _place(a, b, zero, 4, buckets), _place(zero, b, zero, 5, buckets),
    ]
    return places, np.repeat(np.arange(len(words)), lengths)


# ---- learning --------------------------------------------------------------------------


class Model(NamedTuple):
    languages: list[str]  # by falling number of words, then by code point
    counts: np.ndarray  # a row each place, a column each language
    totals: np.ndarray  # characters and ends per language
    buckets: int

    def likelihoods(self, words: pa.Array) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        step = max(1, (1 << 21) // (8 * len(self.languages)))
        totals, lean = self.totals.astype(np.float32), np.float32(LEAN)
        for at in range(0, len(words), step):
            part = words.slice(at, step)
            (three, two, one, of_three, of_two), owner = ngram_places(part, self.buckets)
            p = (self.counts[one] + np.float32(0.5)) / (totals + np.float32(0.5 * self.buckets))
            p = (self.counts[two] + lean * p) / (self.counts[of_two] + lean)
            p = (self.counts[three] + lean * p) / (self.counts[of_three] + lean)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            logs = np.log(np.minimum(p, np.float32(1)))
            out[at : at + step] = np.add.reduceat(logs, first, axis=0, dtype=np.float64)
        return out


def _ngram_counts(labelled: DataFrame, buckets: int) -> DataFrame:
    """``lang, place, n``: n-grams of the labelled texts; place -1 counts characters and ends, -2 words."""

    def run(batches):
        for part in slices(batches, most=PART_BYTES):
            langs = pc.dictionary_encode(part.column("lang"))
            names, of = langs.dictionary, langs.indices.to_numpy()
            words = words_of(part.column("text"))
            if not len(words.doc):
                continue
            lang = of[words.doc]
            pairs, inverse = np.unique(lang * len(words.distinct) + words.word, return_inverse=True)
            counts = np.bincount(inverse, weights=words.count)
            lang, word = np.divmod(pairs, len(words.distinct))
            places, owner = ngram_places(words.distinct, buckets)
            first = np.searchsorted(owner, np.arange(len(words.distinct) + 1))
            sizes = np.diff(first)[word]
            rows = _runs(first[word], sizes)
            weight, of_row = np.repeat(counts, sizes), np.repeat(lang, sizes) * np.int64(buckets)
            for k in range(len(names)):
                mine = of_row == k * np.int64(buckets)
                total = np.zeros(buckets + 2)
                for place in places:
                    total[:buckets] += np.bincount(place[rows[mine]], weights=weight[mine], minlength=buckets)
                total[-1], total[-2] = weight[mine].sum(), counts[lang == k].sum()
                used = np.flatnonzero(total)
                place = np.where(used < buckets, used, used - buckets - 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k].as_py()] * len(used), pa.string()), pa.array(place, pa.int32()), pa.array(total[used], pa.int64())],
                    names=["lang", "place", "n"],
                )

    rows = labelled.select("text", "lang").mapInArrow(run, "lang string, place int, n bigint")
    return rows.groupBy("lang", "place").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, buckets: int = BUCKETS) -> Model:
    """A model of all documents with a language, whatever their id."""
    labelled = only(docs, "text", "lang").withColumn("lang", F.col("lang").cast("string")).where("lang IS NOT NULL AND text IS NOT NULL")
    n_languages = labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if n_languages > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    while n_languages * buckets > MODEL_ENTRIES and buckets > 256:
        buckets //= 2
    table = _ngram_counts(labelled, buckets).toArrow()
    place, n = table["place"].to_numpy(), table["n"].to_numpy()
    encoded = pc.dictionary_encode(table["lang"].combine_chunks())
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    names, of = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
    words = np.zeros(len(names), np.int64)
    words[of[place == -2]] = n[place == -2]
    order = sorted(range(len(names)), key=lambda k: (-words[k], names[k]))
    rank = np.argsort(order) if names else np.zeros(0, np.int64)
    counts = np.zeros((buckets, len(names)), np.float32)
    inside = place >= 0
    counts[place[inside], rank[of[inside]]] = n[inside]
    totals = np.zeros(len(names))
    totals[rank[of[place == -1]]] = n[place == -1]
    return Model([names[k] for k in order], counts, totals, buckets)


# ---- mixtures --------------------------------------------------------------------------


def mixtures(
    logs: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int, allowed: np.ndarray, least: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood per document by expectation-maximisation, starting from equal shares.

    ``logs`` has a row each word of a document (documents in rising order) and a column each language;
    ``allowed`` says per document which languages its mixture may have.  A document whose
    likelihood cannot come above ``least`` is given up, its value minus infinity: the likelihood is concave in the
    proportions, so it lies no more than words times (largest slope - 1) above any point of the way.
    """
    shares = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    value = np.zeros(n_docs)
    if not len(doc):
        return shares, value
    top = logs.max(axis=1)
    # relative likelihoods, of which the least are kept above zero
    likely = np.exp(np.maximum(logs - top[:, None], -600.0))
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    sizes = np.diff(np.append(first, len(doc)))
    at, totals, tops = doc[first], np.add.reduceat(count, first), np.add.reduceat(top * count, first)
    part, weights = likely, count  # rows of the documents still at work, their sizes and starts
    starts, settled = first, np.zeros(len(first), bool)
    for number in range(ROUNDS):
        sums = (np.repeat(shares[at], sizes, axis=0) * part).sum(axis=1)
        slopes = np.add.reduceat(part * (weights / sums)[:, None], starts, axis=0) / totals[:, None]
        old = shares[at]
        new = np.where(settled[:, None], old, old * slopes)  # a document's rounds do not depend on others
        shares[at] = new
        settled |= np.abs(new - old).max(axis=1) <= CLOSE
        if least is not None and number:
            reached = np.add.reduceat(np.log(sums) * weights, starts) + tops
            rise = totals * np.maximum((slopes * (old > 0)).max(axis=1) - 1, 0)
            lost = reached + rise <= least[at]
            value[at[lost]] = -np.inf
            settled |= lost
        if settled.all():
            break
        if settled.mean() > 0.2:  # documents that have settled are left alone
            rows = np.repeat(~settled, sizes)
            part, weights = part[rows], weights[rows]
            at, totals, tops, sizes = at[~settled], totals[~settled], tops[~settled], sizes[~settled]
            starts, settled = np.cumsum(sizes) - sizes, np.zeros(len(at), bool)
    judged = np.isfinite(value[doc])
    mixed = np.log((shares[doc[judged]] * likely[judged]).sum(axis=1)) + top[judged]
    np.add.at(value, doc[judged], mixed * count[judged])
    return shares, value


def choose(logs: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document the shares of the chosen set, its best language and the score."""
    n_langs = logs.shape[1]
    words = np.bincount(doc, weights=count, minlength=n_docs)
    single = np.zeros((n_docs, n_langs))
    np.add.at(single, doc, logs * count[:, None])
    every = np.ones((n_docs, n_langs))
    best_set = np.zeros((n_docs, n_langs))
    start = single.argmax(axis=1)  # the best set of one is known exactly
    best_set[np.arange(n_docs), start] = 1
    best_shares, best_value = best_set.copy(), single[np.arange(n_docs), start]
    cost = PENALTY * np.log(np.maximum(words, 2)) + WORD_COST * words
    # no set explains a text better than all languages do together
    full, most = mixtures(logs, doc, count, n_docs, every, best_value + cost)
    order = np.argsort(-full, axis=1, kind="stable")
    growing = (words > 0) & (most - cost > best_value)
    for size in range(2, n_langs + 1):
        allowed = np.zeros((n_docs, n_langs))
        np.put_along_axis(allowed, order[:, :size], 1, axis=1)
        if not growing.any():
            break
        mine = growing[doc]
        shares, value = mixtures(logs[mine], doc[mine], count[mine], n_docs, allowed)
        better = growing & (value - cost * (size - 1) > best_value)
        best_set[better], best_shares[better] = allowed[better], shares[better]
        best_value = np.where(better, value - cost * (size - 1), best_value)
        growing = better
    best = best_shares.argmax(axis=1)
    # the chosen share, less the chance that a language outside the set explains the text alone
    rest = np.exp(np.maximum(single - single.max(axis=1, keepdims=True), -600.0))
    rest /= rest.sum(axis=1, keepdims=True)
    outside = (rest * (1 - best_set)).sum(axis=1)
    score = best_shares[np.arange(n_docs), best] * (1 - outside)
    return best_shares, best, np.clip(score, 0.0, 1.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred, score`` and ``languages``, the chosen set with its proportions, largest first.

    ``docs`` has ``text`` and other columns that do not enter the prediction.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != "text"]
    language = pa.struct([("lang", pa.string()), ("share", pa.float64())])

    def rows_of(part, model):
        n, langs = part.num_rows, model.languages
        words = words_of(part.column("text"))
        pred, score, sets = [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]
        if langs and len(words.doc):
            likely = model.likelihoods(words.distinct)
            for low, high in _parts(words.doc, len(langs)):
                doc, first = words.doc[low:high], words.doc[low]
                shares, best, sure = choose(likely[words.word[low:high]], doc - first, words.count[low:high].astype(float), int(doc[-1] - first) + 1)
                for k in np.unique(doc):
                    mine = shares[k - first]
                    pred[k], score[k] = langs[best[k - first]], round(float(sure[k - first]), DIGITS)
                    chosen = sorted(np.flatnonzero(mine > 0), key=lambda i: (-mine[i], i))  # noqa: B023
                    sets[k] = [{"lang": langs[i], "share": round(float(mine[i]), DIGITS)} for i in chosen]
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(language))]

    def run(batches):
        model = sent.value
        for part in slices(batches, most=PART_BYTES):
            made = [part.column(c) for c in others] + rows_of(part, model)
            yield pa.RecordBatch.from_arrays(made, names=[*others, "lang_pred", "score", "languages"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def _parts(doc: np.ndarray, n_langs: int, most: int = 1 << 22):
    """Ranges of rows that hold whole documents and, but for one long document, so many likelihoods at most."""
    part = np.arange(len(doc)) * n_langs // most
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    of_doc = part[first]
    cuts = first[np.flatnonzero(np.diff(of_doc, prepend=-1))]
    return list(zip(cuts, [*cuts[1:], len(doc)], strict=True))


def identify(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` of every row, learned from those not held out."""
    model = learn(docs.where(~held_out(F.col("doc_id"))), buckets)
    asked = only(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(asked, model)
