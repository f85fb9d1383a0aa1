"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed byte 4-grams, counted over all training texts. A document is a mixture of
languages plus a noise component (the uniform distribution); its words are drawn from one component each, a word's
likelihood being the product of its 4-grams'. Expectation-maximisation finds the shares; nested sets of the leading
components are fitted again, and the set of the highest penalised likelihood is the answer.

Edge cases: a null text, an empty one and one without a letter are ``und`` with score 0 and no languages. Repeated rows are
answered alike, each once. Rows without a language or a text teach nothing. No training row at all makes every document
``und``. Ties between languages go to the first by code point. Other columns of the input are neither read nor returned,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.kernels import Block, blocks

#: Hash buckets of 4-grams; the model holds one number per language and bucket.
BUCKETS = 1 << 16
#: Languages that a model may hold: bounds its size to 134 MB as float32.
MOST_LANGUAGES = 512
#: Added to every bucket's count.
PRIOR = 0.5
#: Rounds of expectation-maximisation: over all components, and over each nested set.
ROUNDS, SET_ROUNDS = 12, 6
#: Penalty for each component of a set, times the logarithm of the number of words.
PENALTY = 2.0
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 0x20
_ASCII_LETTER = np.array([i < 128 and chr(i).isalpha() for i in range(256)])


def _grams(block: Block) -> np.ndarray:
    """The bucket of the 4-gram that begins one byte before each byte, inside words and across single gaps."""
    b = np.full(len(block.data) + 3, 0x20, np.uint32)
    b[1:-2] = _FOLD[block.data]
    u = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    return (u * np.uint32(2654435761)) >> np.uint32(16)


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, bucket, n)`` over all texts of known language; each task sums up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for block in blocks(batch.column(0)):
                gram, used = _grams(block), _FOLD[block.data] != 0x20
                of = langs[block.row:block.row + block.n]
                for name in set(of):
                    mine = np.repeat(of == name, np.diff(block.offsets)) & used
                    counts[name] = counts.get(name, 0) + np.bincount(gram[mine], minlength=BUCKETS)
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                   pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    known = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    return (known.mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


class Model:
    """Log-probabilities by language and bucket; its size depends on the number of languages only."""

    def __init__(self, counts: DataFrame):
        names = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
        if len(names) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        table = np.full((len(names), BUCKETS), PRIOR)
        rows = counts.toArrow()
        row = {name: k for k, name in enumerate(names)}
        table[[row[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
        self.names = names
        self.log = np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if names else table.astype(np.float32)


def _mix(ll: np.ndarray, top: np.ndarray, doc: np.ndarray, first: np.ndarray, words: np.ndarray, allowed: np.ndarray,
         rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood of each document as a mixture of its allowed components."""
    share = (allowed / allowed.sum(1, keepdims=True)).astype(np.float32)
    for _ in range(rounds):
        part = ll * share[doc]
        whole = part.sum(1)
        part /= np.maximum(whole, 1e-30)[:, None]
        share = np.add.reduceat(part, first) / words[:, None]
    whole = (ll * share[doc]).sum(1)
    return share, np.add.reduceat(np.log(np.maximum(whole, 1e-30), dtype=np.float64) + top, first)


def _infer(block: Block, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each document with words of letters: its row in the block, and the shares of its chosen components (noise last)."""
    used = _FOLD[block.data] != 0x20
    starts, ends, doc = block.runs(used)
    if not len(starts) or not model.names:
        return np.zeros(0, np.int64), np.zeros((0, len(model.names) + 1))
    gram = _grams(block)
    ll = np.empty((len(starts), len(model.names) + 1), np.float32)
    for k in range(len(model.names)):
        total = np.concatenate([[0.0], np.cumsum(model.log[k][gram] * used, dtype=np.float64)])
        ll[:, k] = total[ends] - total[starts]
    ll[:, -1] = (ends - starts) * -np.log(BUCKETS)
    top = ll.max(1)
    ll = np.exp(ll - top[:, None])
    top = top.astype(np.float64)
    rows, first, words = np.unique(doc, return_index=True, return_counts=True)
    doc = np.repeat(np.arange(len(rows)), words)
    share, _ = _mix(ll, top, doc, first, words, np.ones((len(rows), ll.shape[1]), np.float32), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    best, at_best = np.zeros_like(share), np.full(len(rows), -np.inf)
    going = np.arange(len(rows))
    allowed = np.zeros_like(share)
    for k in range(ll.shape[1]):
        allowed[np.arange(len(rows)), order[:, k]] = 1
        inside = np.zeros(len(rows), bool)
        inside[going] = True
        part = inside[doc]
        count = words[going]
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        new, value = _mix(ll[part], top[part], np.repeat(np.arange(len(going)), count), begin, count, allowed[going],
                          SET_ROUNDS if k else 0)
        value -= PENALTY * (k + 1) * np.log(count + 1)
        better = value > at_best[going]
        going = going[better]
        best[going], at_best[going] = new[better], value[better]
        if not len(going):
            break
    return rows, np.concatenate([best, share], 1)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score, languages, shares, noise)`` for every row.

    ``lang_pred`` is the leading language of the chosen set and ``score`` its share among the languages of the set (0 to
    1); ``languages`` and ``shares`` give the whole set, ``noise`` the share of words that fit no language. The model is
    sent to every task: at most MOST_LANGUAGES times BUCKETS numbers.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.log))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.__new__(Model)
        known.names, known.log = sent.value
        n = len(known.names)
        for batch in batches:
            texts = batch.column(1)
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            sets, shares, noise = [[] for _ in pred], [[] for _ in pred], np.zeros(len(texts))
            for block in blocks(texts):
                rows, found = _infer(block, known)
                lettered = block.total(_ASCII_LETTER[block.data]) > 0
                for row, one in zip(rows, found):
                    at = block.row + int(row)
                    if not lettered[row] and not any(c.isalpha() for c in texts[at].as_py()):
                        continue
                    chosen, full = one[:n + 1], one[n + 1:2 * n + 1]
                    real = chosen[:n].sum()
                    noise[at] = chosen[n]
                    use = chosen[:n] if real > 0 else full
                    lead = int(np.argmax(use))
                    pred[at], score[at] = known.names[lead], min(1.0, float(use[lead] / max(use.sum(), 1e-30)))
                    for k in np.argsort(-chosen[:n], kind="stable"):
                        if chosen[k] > 0:
                            sets[at].append(known.names[k])
                            shares[at].append(float(chosen[k]))
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(score),
                                   pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())),
                                   pa.array(noise)], schema=out)

    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))
    out = pa.schema([(key, _arrow(rows, key)), ("lang_pred", pa.string()), ("score", pa.float64()),
                     ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64())), ("noise", pa.float64())])
    return rows.mapInArrow(predict, f"`{key}` {rows.schema[key].dataType.simpleString()}, lang_pred string, score double, "
                                    "languages array<string>, shares array<double>, noise double")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def held_out(key) -> F.Column:
    """A fifth of the keys, by the CRC of their text; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from all documents outside the held-out fifth."""
    return Model(count_grams(docs.where(~held_out(key)), text, lang))
