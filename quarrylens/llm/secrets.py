"""Secret scans: candidate strings, judged by a random forest.

Candidates are private key blocks, passwords in addresses, what follows ``Bearer`` or ``Basic``, whatever is assigned to a word that
names a secret, and long runs of characters that keys and tokens are made of. Some findings have a label that is beyond doubt: by
the word that names them, or by a form that only keys have (1); by a word that names them harmless, or as plain words, numbers and
addresses (0). A random forest learns from these what a secret looks like: its length, its transitions between kinds of characters,
how far words of a dictionary cover it, the path it comes from, and the words around it. The words that give a label are no feature,
so the forest also judges findings that nothing names; these alone are left to it. The dictionary is what ordinary text repeats:
the letter 4-grams of all texts, counted in a table of fixed size.

Edge cases: a null or empty text has no candidates; very long texts are scanned whole. Repeated rows are scanned alike, each once.
With fewer than LEAST_OF_CLASS different strings of either label no forest is trained: the probability is null, and a finding
is a secret if its label says so. An empty table gives no findings. Only the key, text and path columns are read; ``redacted`` keeps
all columns and changes the text alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, marked, small_batches
from quarrylens.llm.kernels import blocks
from quarrylens.llm.languages import _arrow

#: Labelled findings used for training at most (chosen by a hash of the string).
TRAIN_FINDINGS = 20_000
TREES, DEPTH, SEED = 40, 8, 11
#: Different strings that each label needs before a forest is trained.
LEAST_OF_CLASS = 10
#: A candidate is a secret from this probability on.
THRESHOLD = 0.5
#: Cells of the dictionary of letter 4-grams, and how often a word occurs per million for its 4-grams to be in it.
DICTIONARY, COMMON_PER_MILLION = 1 << 16, 20
#: Code points looked at before and after a candidate.
AROUND = 48
#: Buckets of hashed neighbouring words and paths.
NEIGHBOURS, PATHS = 16, 8
MASK = "[SECRET]"

# Words that name a secret, and words that name harmless strings.
SECRET_WORDS = ("secret", "token", "password", "passwd", "pwd", "apikey", "api_key", "access_key", "private_key", "credential", "auth", "bearer")
HARMLESS_WORDS = ("sha256", "sha1", "md5", "checksum", "commit", "uuid", "guid", "isbn", "example", "card", "phone", "http", "https", "www")

#: A secret's name and what stands between it and the value.
_NAMED = rf"(?:{'|'.join(SECRET_WORDS)})[\"'`]?\s{{0,8}}[=:]\s{{0,8}}[\"'`]?"
#: What a candidate looks like: a private key block; the password of an address; what follows an authorisation scheme; the value
#: assigned to a secret's name, of any length and characters but blanks; or else a long run of characters that keys are made of,
#: which ends at ``=`` unless that is its padding. For Java: bounded lookbehind; short ones only spare the long ones behind them.
CANDIDATE = (r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END [A-Z ]{0,24}PRIVATE KEY-----"
             r"|(?<=:)(?<=://[^\s:/@]{1,64}:)[^\s/@]+(?=@)"
             r"|(?<=[rRcC]\s)(?<=(?i:bearer|basic)\s)[A-Za-z0-9+/_.~-]{8,}={0,2}"
             r"|(?<=[=:\s\"'`])(?=\S)(?<=[=:]\s{0,8}[\"'`]?)" + rf"(?<=(?i:{_NAMED}))(?!(?i:bearer|basic)\s)"
             r"(?:(?<=\")[^\s\"]+|(?<=')[^\s']+|(?<=`)[^\s`]+|(?<![\"'`])[^\s\"'`]*[^\s\"'`,;)\]}])"
             r"|(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
# Forms that only keys have.
SURE_FORM = (r"^(?:-----BEGIN |gh[pousr]_[A-Za-z0-9]{36}|AKIA[A-Z0-9]{16}$|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}"
             r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$)")
#: What stands before the password of an address, and before a credential in a header.
_CARRIED = r"(?:://[^\s:/@]{1,64}:|\b(?:bearer|basic)\s)$"

FEATURES = ("length", "digits", "upper", "lower", "marks", "changes", "entropy", "hex", "covered", "longest_letters", "quoted",
            "checksum", *(f"word_{k}" for k in range(NEIGHBOURS)), *(f"path_{k}" for k in range(PATHS)))


def dictionary(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Which letter 4-grams ordinary text repeats: DICTIONARY flags, whatever the size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DICTIONARY, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                b = block.data
                if len(b) < 4:
                    continue
                lower = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint32)
                letter = (lower >= 97) & (lower <= 122)
                inside = letter[:-3] & letter[1:-2] & letter[2:-1] & letter[3:]
                total += np.bincount(_gram(lower)[inside], minlength=DICTIONARY)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    counts = (docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "cell int, n long")
              .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    table = np.zeros(DICTIONARY, np.int64)
    table[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    return table * 1_000_000 >= COMMON_PER_MILLION * max(1, int(table.sum()))


def _gram(b: np.ndarray) -> np.ndarray:
    return ((b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(2654435761)) >> np.uint32(16)


def _bucket(word: str, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % n


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3


def _checksum(digits: str) -> bool:
    """Whether a digit string ends in its own check digit."""
    doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def features(value: str, before: str, after: str, path: str, known: np.ndarray) -> list[float]:
    kinds = [_kind(c) for c in value]
    n = len(value)
    share = [kinds.count(k) / n for k in range(4)]
    entropy = -sum(p * math.log2(p) for p in (value.count(c) / n for c in set(value)))
    b = np.frombuffer(value.lower().encode(), np.uint8).astype(np.uint32)
    hit = known[_gram(b)] if len(b) > 3 else np.zeros(0, bool)
    covered = np.zeros(len(b), bool)
    for k in range(4):
        covered[k:k + len(hit)] |= hit
    words = re.findall(r"[\w.-]+", before.lower())[-3:] + re.findall(r"[\w.-]+", after.lower())[:2]
    words = [w for w in words if not any(name in w for name in (*SECRET_WORDS, *HARMLESS_WORDS))]  # those give labels
    row = [n, share[0], share[2], share[1], share[3], sum(x != y for x, y in zip(kinds, kinds[1:])) / n, entropy,
           float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None), float(covered.mean()),
           max((len(m) for m in re.findall(r"[A-Za-z]+", value)), default=0),
           float(before[-1:] in ("\"", "'", "`")), float(value.isdecimal() and _checksum(value))]
    counts = [0.0] * NEIGHBOURS
    for w in words:
        counts[_bucket(w, NEIGHBOURS)] += 1
    place = [0.0] * PATHS
    place[_bucket(path, PATHS)] = 1
    return [float(x) for x in row] + counts + place


def candidates(docs: DataFrame, known: np.ndarray, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """``(key, begin, value, before, features)`` of every candidate in every text; ``begin`` counts code points.

    Texts without candidates end in the filter. Of the others Python gets the candidates, and of the text between two of them its
    length and the ends that can lie around one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)
    whole = F.col(text).cast("string")

    def short(gap: Column) -> Column:
        return F.when(F.length(gap) > 2 * AROUND, F.concat(F.left(gap, F.lit(AROUND)), F.right(gap, F.lit(AROUND)))).otherwise(gap)

    gaps = F.transform(F.split(whole, CANDIDATE, -1), lambda gap: F.struct(F.length(gap).alias("n"), short(gap).alias("ends")))
    rows = docs.where(whole.rlike(CANDIDATE)).select(
        F.col(key).alias(key), gaps.alias("gaps"), F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0)).alias("values"),
        (F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))).alias("path"))
    schema = pa.schema([(key, _arrow(rows, key)), ("begin", pa.int64()), ("value", pa.string()), ("before", pa.string()),
                        ("features", pa.list_(pa.float64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary_ = sent.value
        for batch in batches:
            at, begin, value, before, row = [], [], [], [], []
            for k in range(batch.num_rows):
                gaps, found, place, here = batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), 0, 0
                text_ = "".join(x for gap, m in zip(gaps, [*found, ""]) for x in (gap["ends"], m))  # gaps are short: here, not place
                for gap, m in zip(gaps, found):
                    place, here = place + gap["n"], here + len(gap["ends"])
                    at.append(k)
                    begin.append(place)
                    value.append(m)
                    before.append(text_[max(0, here - AROUND):here])
                    place, here = place + len(m), here + len(m)
                    row.append(features(m, before[-1], text_[here:here + AROUND], batch.column(3)[k].as_py(), dictionary_))
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(begin, pa.int64()), pa.array(value, pa.string()),
                                   pa.array(before, pa.string()), pa.array(row, pa.list_(pa.float64()))], schema=schema)

    return rows.mapInArrow(find, f"`{key}` {rows.schema[key].dataType.simpleString()}, begin long, value string, before string, features array<double>")


def labelled(found: DataFrame) -> DataFrame:
    """Findings whose label is beyond doubt: named as a secret, carried as one, or of a form that only keys have (1); words, numbers,
    addresses and strings named as harmless (0). Others have a null label."""
    value, before = F.col("value"), F.lower("before")
    said = before.rlike(rf"{_NAMED}$") & value.rlike("[0-9]|[^\\w.,:-]")
    sure = value.rlike(SURE_FORM) | before.rlike(_CARRIED)
    harmless = (value.rlike(r"^[A-Za-z/_.-]+$") | value.rlike(r"^[0-9.+-]+$") | value.rlike(r"^[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,6}(?:/|$)")
                | before.rlike(rf"(?:{'|'.join(HARMLESS_WORDS)})\W*$"))
    return found.withColumn("label", F.when(said | sure, 1.0).when(harmless & ~before.rlike(rf"{_NAMED}$"), 0.0))


def train(findings: DataFrame, most: int = TRAIN_FINDINGS):
    """A forest from ``findings(value, features, label)``; copies of a string count once. None where a class has too few strings.

    Strings are taken in order of a hash, at most ``most`` of them, half of them at most of each label; both labels weigh the same.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    ones = findings.where("label is not null").groupBy("value", "label").agg(F.min("features").alias("features"))
    parts = [ones.where(F.col("label") == y).orderBy(F.xxhash64("value"), "value").limit(most // 2) for y in (0.0, 1.0)]
    rows = parts[0].unionByName(parts[1]).select("label", array_to_vector("features").alias("features")).persist()
    try:
        sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(sizes) < 2 or min(sizes.values()) < LEAST_OF_CLASS:
            return None
        weight = F.when(F.col("label") == 1, F.lit(0.5 / sizes[1.0])).otherwise(F.lit(0.5 / sizes[0.0])) * F.lit(float(sum(sizes.values())))
        return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2, weightCol="weight").fit(
            rows.withColumn("weight", weight))
    finally:
        rows.unpersist()


def judged(found: DataFrame, forest, threshold: float = THRESHOLD) -> DataFrame:
    """``found`` with ``probability`` and ``secret``: the label where it is beyond doubt, else what the forest says."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rated = labelled(found)
    if forest is None:
        rated = rated.withColumn("probability", F.lit(None).cast("double"))
    else:
        rated = forest.transform(rated.withColumn("features", array_to_vector("features"))).withColumn("probability", vector_to_array("probability")[1])
    secret = F.coalesce(F.col("label") == 1, F.col("probability") >= threshold, F.lit(False))
    return rated.select(*[c for c in found.columns if c != "features"], "probability", secret.alias("secret"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """Findings of a corpus, judged by a forest that learns from those of its findings whose label is beyond doubt."""
    with small_batches(docs.sparkSession):
        found = cut(candidates(docs, dictionary(docs, text), key, text, path), "candidates")
    return judged(found, train(labelled(found)))


def redacted(docs: DataFrame, findings: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret of ``findings`` masked in ``text``.

    Secrets are looked up by the digest of the text's candidates, so rows need no key. Texts and their secrets are written to the
    shared folder by digest first; texts without secrets then stay in their task and are not searched again. A secret found once
    is masked wherever it occurs as a candidate.
    """
    columns, whole, row = docs.columns, F.col(text), F.sha2(F.col(text), 256)
    found = F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0))
    secret = findings.where("secret").select(F.sha2("value", 256).alias("__digest")).distinct()
    values = docs.where(whole.rlike(CANDIDATE)).select(row.alias("__row"), F.explode(F.array_distinct(found)).alias("value")).distinct()
    masks = cut(values.join(secret, F.sha2("value", 256) == F.col("__digest"), "left_semi")
                .groupBy(F.col("__row").alias("__of")).agg(F.collect_set("value").alias("__secret")), "masks")
    parts = marked(docs.withColumn("__row", row), F.col("__row"), masks.select("__of"), "__perhaps")
    some = parts.where("__perhaps").withColumn("__values", found).join(masks, F.col("__row") == F.col("__of"), "left")
    gaps: Column = F.split(whole, CANDIDATE, -1)
    masked = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(
        F.when(F.array_contains("__secret", F.get("__values", i)), F.lit(MASK)), F.get("__values", i), F.lit("")))), "")
    text_ = F.when(F.col("__secret").isNull(), whole).otherwise(masked)
    changed = some.select(*[text_.alias(c) if c == text else c for c in columns])
    return parts.where("not __perhaps").select(columns).union(changed)
