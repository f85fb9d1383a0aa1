"""Ranked search, decontamination and conversation repair against brute force and odd input."""

from __future__ import annotations

import collections
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import pytest
from llm_samples import prose
from pyspark.sql import functions as F

from quarrylens.llm import contamination, ranking, repair

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def _brute_search(docs, items):
    bags = [(i, collections.Counter(_terms(t))) for i, t in docs]
    full = [b for _, b in bags if b]
    many, length = len(full), sum(sum(b.values()) for b in full)
    df = collections.Counter(w for b in full for w in b)
    out = []
    for item, text in set(items):
        scored = []
        for i, bag in bags:
            m = bag and 25 + 75 * sum(bag.values()) * many // length
            score = sum(times * math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 8 * m))
                        for w, times in collections.Counter(_terms(text)).items() if w in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(heapq.nsmallest(10, scored))]
    return sorted(out, key=repr)


def _found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = "item_id long, text string, score int, rank string, cell int"


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(k, prose(k, 12 + k)) for k in range(10, 18)] + [(30, None), (31, ""), (32, "!!"), (33, "kana KANA kana"), (33, "lonor"), (34, "ÜNÏ Ünï")]
    rows += rows[:2]
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], ITEMS)


@pytest.mark.parametrize("documents_of_cell, block, short, summary", [(4096, 64, 8, 512), (16, 2, 2, 3), (7, 3, 4, 1)])
def test_search_equals_brute_force(spark, documents, questions, monkeypatch, documents_of_cell, block, short, summary):
    for name, value in (("CELL_DOCUMENTS", documents_of_cell), ("BLOCK", block), ("SHORT", short), ("SUMMARY", summary)):
        monkeypatch.setattr(ranking, name, value)
    more = spark.createDataFrame([(None, prose(12, 40), None, None, 0, "v", 1, 2)] * 3, documents.schema)
    docs = documents.union(more)
    want = _brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in questions.collect()])
    assert _found(ranking.search(docs, questions)) == want


def test_search_in_several_query_blocks(spark, documents, questions, monkeypatch):
    monkeypatch.setattr(ranking, "VOCABULARY", 60)
    want = _brute_search([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in questions.collect()])
    assert _found(ranking.search(documents, questions)) == want


def test_search_cell_returns_only_what_bounds_allow():
    """The bound of every block and cell is at least the score of every document in it, and the best are found at any demand."""
    draw = random.Random(3)
    asked = ranking.Questions([(q, collections.Counter(draw.choices([b"w%d" % k for k in range(80)], k=12))) for q in range(9)])
    n = 300
    bags = [collections.Counter(draw.choices(range(len(asked.words)), k=draw.randint(1, 25))) for _ in range(n)]
    import numpy as np

    asked.weigh(n, sum(sum(b.values()) for b in bags), np.array([sum(w in b for b in bags) for w in range(len(asked.words))]))
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    words = np.array([w for b in bags for w in sorted(b)])
    counts = np.array([b[w] for b in bags for w in sorted(b)])
    lengths = np.array([sum(b.values()) for b in bags])
    row = ranking._cell(asked, asked.partners(), list(range(n)), lengths, starts, words, counts)
    cell = ranking._Opened(row, asked, asked.partners())
    impacts = ranking._impacts(asked, lengths, np.diff(starts), counts)
    for q in range(9):
        weight = np.zeros(len(asked.words), np.int64)
        weight[asked.terms[asked.of(q)]] = asked.weights[asked.of(q)]
        scores = [int(s) for s in np.add.reduceat(weight[words] * impacts, starts[:-1])]
        ranked = sorted(((s, -k) for k, s in enumerate(scores) if s > 0), reverse=True)
        assert cell.bounds()[q] >= ranked[0][0]
        for least in (1, ranked[9][0], ranked[2][0], ranked[0][0], ranked[0][0] + 1):
            assert cell.best(q, least, 10) == [(s, -k) for s, k in ranked if s >= least][:10]


def test_search_of_empty_tables(spark, no_documents, documents, questions):
    assert ranking.search(no_documents, questions).columns == ["item_id", "rank", "doc_id", "score"]
    assert _found(ranking.search(no_documents, questions)) == []
    assert _found(ranking.search(documents, questions.where("false"))) == []


def _brute_contamination(docs, items, window=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = _terms(text)
        size = min(len(words), window)
        for k in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[k:k + size])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        words, hit, found = _terms(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (own := tuple(words[k:k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[own]
        out.append((i, len(words), len(hit), len(found), sorted(found)))
    return sorted(out, key=repr)


def test_contamination_equals_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    passage = " ".join(texts[14].split()[5:60])
    long = f"{prose(99, 20000)} {passage} {prose(98, 5000)} {passage.upper()}"
    more = spark.createDataFrame([(k, t, None, None, 0, "v", 1, 2) for k, t in
                                  [(200, long), (201, "kana kana kana kana"), (202, passage), (202, passage), (None, f"x {passage} y")]], documents.schema)
    docs = documents.union(more)
    items = [(1, passage), (2, " ".join(texts[14].split()[20:32])), (3, "kana"), (4, "Kana, kana!"), (5, prose(77, 30)), (6, None), (7, " ..."), (8, "one"),
             (10, passage), (None, " ".join(texts[16].split()[:10])), (9, "ünï cödé"), (1, "mistor mistor")]
    held = spark.createDataFrame([(i, t, 0, 1) for i, t in items], "item_id long, text string, row int, window int")
    got = sorted((tuple(r) for r in contamination.contaminated(docs, held).select("doc_id", "n_words", "n_hit", "n_items", "items").collect()), key=repr)
    assert got == _brute_contamination([(r.doc_id, r.text) for r in docs.collect()], items)


def test_contamination_of_empty_tables(spark, documents, no_documents):
    items = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    assert contamination.contaminated(no_documents, items).count() == 0
    got = contamination.contaminated(documents, items.where("false"))
    assert got.where("n_hit = 0 and n_items = 0").count() == documents.count()


def test_a_full_bitmap_changes_nothing(spark, documents, monkeypatch):
    items = spark.createDataFrame([(k, prose(k, 25)) for k in range(10, 16)], "item_id long, text string")
    want = sorted(map(repr, contamination.contaminated(documents, items).collect()))
    monkeypatch.setattr(contamination, "LEAST_BITS", 6)
    monkeypatch.setattr(contamination, "MOST_BITS", 6)
    assert sorted(map(repr, contamination.contaminated(documents, items).collect())) == want


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def _brute_repair(rows):
    """Every edit script of cheapest cost by search over positions and roles said, without any automaton."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, found = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def fits(last, role):
        return role in {"": "su", "s": "u", "u": "a", "a": "u"}[last]

    # equal (row, last role said) are alike for what follows, as the whole must match (s?(ua)+)?
    heap, settled = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, said = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            break
        if (at, last) in settled:
            continue
        settled.add((at, last))
        for new, name in (("u", "user"), ("a", "assistant")):
            if fits(last, new):
                heapq.heappush(heap, (cost + 3, audit + "I", at, new, (*said, f"{name}:")))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, said))
            if found[at] not in ("blank", "duplicate"):
                more = 3 * (found[at] == "truncated")
                if role and fits(last, role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], (*said, f"{role}:{text}")))
                for new, name in (("u", "user"), ("a", "assistant")):
                    if fits(last, new):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, new, (*said, f"{name}:{text}")))
    turns = [r[1] for r in rows if r[1] is not None]
    wrong = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), wrong, cost,
            audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


@pytest.fixture(scope="module")
def talks(spark):
    draw = random.Random(8)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, draw.choice([turn, turn, turn, turn + 2, None]), draw.choice(["user", "assistant", "assistant", "user", "system", "tool", None, ""]),
                         draw.choice(["Yes.", "No!", "So it is", "", " ", None, "Ünï.", "a:b\nc?", f"Say {turn}."])))
    rows += [(99, k, ("user", "assistant")[k % 2], f"Turn {k % 150}.") for k in range(400)] + [(98, 3, "user", "x" * 30000 + ".")]
    rows += rows[:5]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, part int, seq int, gone int")


def _by_conv(rows):
    held = collections.defaultdict(list)
    for r in rows:
        held[r[0]].append(r)
    return held


@pytest.mark.parametrize("rows_of_piece, partitions", [(4096, 8), (3, 8), (1, 3), (50, 1)])
def test_repair_equals_brute_force(spark, talks, monkeypatch, rows_of_piece, partitions):
    monkeypatch.setattr(repair, "PIECE_ROWS", rows_of_piece)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[0]: tuple(r[1:]) for r in repair.repair(repair.damaged(talks), gone="gone").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = [tuple(r[:4]) for r in talks.collect()]
    left = _by_conv(_damage(rows))
    assert got == {conv: _brute_repair(left.get(conv, [])) for conv in _by_conv(rows)}


def test_repair_of_nothing(spark, talks):
    assert repair.repair(repair.damaged(talks.where("false")), gone="gone").count() == 0
    gone = spark.createDataFrame([(5, 0, "user", "a.", True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert tuple(repair.repair(gone, gone="gone").first()) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_parser_follows_the_grammar():
    parser = repair.Parser()
    for n in range(7):
        for word in map("".join, itertools.product("sua", repeat=n)):
            fronts = {parser.empty}
            for role in word:
                fronts = {m for s in fronts for m in parser.step(s, role)}
            assert any(map(parser.accepts, fronts)) == bool(re.fullmatch("(s?(ua)+)?", word)), word
    assert len(parser.stacks()) <= 8
    with pytest.raises(ValueError, match="left recursive"):
        repair.Parser({"C": ("", "P"), "P": ("ua", "uaP")}).stacks()
