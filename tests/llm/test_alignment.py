"""Alignment against whole-text encoding and pairwise comparison of byte ranges; fragments under any cutting."""

import collections
import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgersift.llm import alignment
from ledgersift.llm.tables import table

SCHEMA = "doc_id long, text string, at long, part string, pairs string"


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(alignment.BYTE_VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_VOCABULARY)


def token_bytes(encoders, text):
    """(id, bytes) of all tokens of the whole text by both tokenizers, or None where they do not give it back."""
    a, b = encoders
    want = (" " + text).encode()
    chars = alignment._byte_level()
    ones = [(i, bytes(chars[c] for c in a.id_to_token(i))) if i != 50256 else (i, b"<|endoftext|>")
            for i in a.encode(" " + text, add_special_tokens=False).ids]
    twos = [(i, alignment._piece_bytes(b.id_to_piece(i))) for i in b.encode(text)]
    if not text or any(b"".join(t for _, t in side) != want for side in (ones, twos)):
        return None
    return ones, twos


def spans(tokens):
    ends = list(itertools.accumulate(len(t) for _, t in tokens))
    return [(i, e - len(t), e) for (i, t), e in zip(tokens, ends, strict=True)]


def brute(encoders, rows):
    docs = []
    for doc_id, text, *_ in rows:
        found = token_bytes(encoders, text or "")
        if found is None:
            docs.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = map(spans, found)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in (a, b)))
            start = cut
        links = [(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)]
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = collections.Counter(p for d in docs for p in set(d[4]))
    best = collections.defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return collections.Counter((d[0], d[1], d[2], d[3], len(d[4]), sum(count[p] == best[p[0]] for p in d[4]),
                                sum(count[p] for p in d[4]), d[5]) for d in docs)


def got(df):
    return collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                               for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    odd = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b ", "\ta\n b", "don't  stop <|endoftext|> now",
           "<s> </s> <unk> <0x0A>", "héllo wörld", "Привет, как дела?", "日本語のテキスト 中文", "a b   c", "a▁b", "😀 😀😀 x",
           "é ﬁ Ω", "x" * 300, "tab\tthen space \t mixed", "1234567 89.01", "\x00 \x1c a", "a　b ​ c",
           "ends with newline\n", "code: if (x==1) { return y; }\r\n    // done"]
    words = ["the", "of", "naïve", "data", "Straße", "слово", "x1", "foo_bar", "--", "it's", "数据", "😀", "  ", "\n", "end."]
    texts = odd + [" ".join(rng.choices(words, k=n)) for n in (3, 10, 40, 400, 900)]
    out = [(k, t) for k, t in enumerate(texts)] + [(3, "a"), (3, "a"), (None, "the of"), (None, "the of")]
    return [(i, t, 1, "p", "q") for i, t in out]


@pytest.mark.parametrize("piece_chars", [32_768, 24])
def test_equals_brute_force(spark, encoders, rows, piece_chars):
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(alignment.aligned(df, piece_chars=piece_chars)) == brute(encoders, rows)


def test_without_hot_pairs_and_in_small_runs(spark, encoders, rows, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_SHARE", 1)
    some = rows[-14:]
    assert got(alignment.aligned(spark.createDataFrame(some, SCHEMA), piece_chars=64)) == brute(encoders, some)


def test_given_table_equals_brute_force(spark, encoders, sf_small):
    docs = table(spark, sf_small, "documents").where("length(text) < 4000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(rows) > 100 and got(alignment.aligned(docs, piece_chars=600)) == brute(encoders, rows)


def test_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA)).collect() == []


def random_tokens(rng, length):
    """Two cuttings of the same bytes."""
    sides = []
    for _ in range(2):
        ends = sorted(rng.sample(range(1, length), rng.randrange(length // 2))) + [length]
        sides.append(alignment.Tokens(np.array([rng.randrange(50) for _ in ends], np.int32), np.array(ends, np.int64)))
    return sides


def as_tuple(one):
    return (one.cut, one.closed, one.n_groups, one.n_a, one.n_b, one.pairs.tolist(), one.times.tolist(),
            [t.ids.tolist() for two in (one.prefix, one.suffix) for t in two],
            [t.ends.tolist() for two in (one.prefix, one.suffix) for t in two])


@pytest.mark.parametrize("seed", range(40))
def test_fragments_compose_in_any_order(seed):
    """Byte ranges cut anywhere, also inside tokens and groups: every way of composing gives the uncut fragment."""
    rng = random.Random(seed)
    length = rng.choice([2, 5, 40, 200])
    a, b = random_tokens(rng, length)
    borders = sorted({0, length, *(rng.randrange(1, length + 1) for _ in range(rng.randrange(12)))})
    parts = []
    for low, high in itertools.pairwise(borders):
        ranges = [slice(*np.searchsorted(side.ends, [low, high], side="right")) for side in (a, b)]
        parts.append(alignment.fragment(a[ranges[0]], b[ranges[1]]))
    whole = as_tuple(alignment.fragment(a, b))
    for _ in range(4):
        left = list(parts)
        while len(left) > 1:
            k = rng.randrange(len(left) - 1)
            left[k:k + 2] = [alignment.compose(left[k], left[k + 1])]
        assert as_tuple(left[0]) == whole
    assert as_tuple(alignment.compose(alignment.EMPTY, parts[0])) == as_tuple(parts[0])
    assert as_tuple(alignment.compose(parts[0], alignment.EMPTY)) == as_tuple(parts[0])
    done = alignment.whole(alignment.fragment(a, b))
    assert done.n_groups == len(set(a.ends.tolist()) & set(b.ends.tolist()))
    assert int(done.times.sum()) == len(set(a.ends.tolist()) | set(b.ends.tolist()))


def test_pieces_cover_the_text():
    text = "ab  cd ef\ngh ijk lm " * 30
    for size in (1, 7, 50, 10_000):
        cut = list(alignment.pieces(text, size))
        assert " ".join(p for _, p in cut) == text
        assert [at for at, _ in cut] == [0, *itertools.accumulate(1 + len(p) for _, p in cut)][:-1]


def test_no_piece_holds_a_space_behind_another_character(encoders):
    """What makes a break a place where the piece vocabulary starts afresh."""
    _, b = encoders
    assert not [i for i in range(b.get_piece_size()) if re.search("[^▁]▁", b.id_to_piece(i))]


def test_no_task_of_a_composing_level_runs_two_python_steps(spark):
    """Each of them would keep a Python worker of its own, beside the first one's, on every core."""
    parts = spark.createDataFrame([(0, 0, k, 0, "a b") for k in range(9)], "at long, doc_id long, part long, place long, piece string")
    composed = alignment._long_documents(parts, (alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY))
    steps = re.findall(r"\b(Exchange|MapInArrow|FlatMapGroupsInArrow)\b(?= )",
                       composed._jdf.queryExecution().executedPlan().toString())
    assert "FlatMapGroupsInArrow" in steps
    assert not [two for two in itertools.pairwise(steps) if "Exchange" not in two]


def pair_batches(documents, each):
    """One batch of documents that link the same pairs."""
    pairs = pa.ListArray.from_arrays(np.arange(0, documents * each + 1, each, dtype=np.int32),
                                     np.tile(np.arange(each, dtype=np.int64), documents))
    times = pa.ListArray.from_arrays(pairs.offsets, np.ones(documents * each, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(documents)), pairs, times], names=["at", "pairs", "times"])


def test_counting_takes_memory_by_stretches_of_a_batch():
    batch = pair_batches(4000, 500)
    tracemalloc.start()
    out = list(alignment._counted(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(b.column("pair").to_pylist(), b.column("n").to_pylist()) for b in out] == [(list(range(500)), [4000] * 500)]
    assert peak < 2 * batch.column("pairs").nbytes


def test_scores_leave_a_batch_in_stretches():
    none = np.zeros(0, np.int64)
    batch = pair_batches(4000, 500)
    out = list(alignment._scored(none, none, none)(iter([batch])))
    assert max(b.num_rows for b in out) <= alignment.STRETCH_PAIRS + alignment.STRETCH_PAIRS // 500
    assert sum(b.num_rows for b in out) == 4000 * 501
    assert sorted(k for b in out for k in b.column("key").to_pylist() if k < 0) == list(range(-4000, 0))


@pytest.mark.parametrize("stretch", [1, 7, 1 << 18])
def test_stretches_hold_all_rows_and_do_not_change_counts(monkeypatch, stretch):
    lists = [[1, 2, 3], [], [2], [2, 9], [], [], [1, 2, 4, 5, 6, 7, 8, 9, 10, 11]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64()))], names=["pairs"])
    monkeypatch.setattr(alignment, "STRETCH_PAIRS", stretch)
    cut = list(alignment._stretches(iter([batch.slice(0, 0), batch.slice(1), batch])))
    assert [r for b in cut for r in b.column("pairs").to_pylist()] == lists[1:] + lists
    assert all(b.num_rows == 1 or len(b.column("pairs").flatten()) <= stretch for b in cut)
    counts = collections.Counter()
    for b in alignment._counted(iter([batch, batch.slice(3)])):
        counts.update(dict(zip(b.column("pair").to_pylist(), b.column("n").to_pylist(), strict=True)))
    assert counts == collections.Counter(itertools.chain.from_iterable(lists + lists[3:]))
