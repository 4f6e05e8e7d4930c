"""The training-text operators against brute force, on small tables with every edge."""

import collections
import hashlib
import itertools
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from ledgersift.llm import (chat, decontaminate, licenses, line_dedup, mixing, near_dups, packing, pii, quality,
                            topk)
from ledgersift.llm.components import components
from ledgersift.llm.queries import QUERIES, SQL
from ledgersift.llm.tables import stored, table

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls, empty and long texts, repeated rows, and a column with a clashing name."""
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{n}" for n in rng.integers(0, 400, 60)) for _ in range(12)]
    rows = []
    for k in range(60):
        text = base[k % 12].split()
        for at in rng.integers(0, len(text), k // 12):
            text[at] = f"x{k}"
        rows.append((k, " ".join(text)))
    rows += [(100, None), (101, ""), (102, "one"), (103, "one"), (104, base[0]), (104, base[0]), (None, base[1]),
             (105, "a long shared line of text here\n" * 3 + "tail"), (106, "A long shared line of text here"),
             (107, " a LONG shared line of text here\t\nown"), (108, " ".join(base) * 40)]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 101 else None, 0, "x") for i, t in rows],
                                 DOCS)


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, sf_small, name):
    assert differences(spark, duck(sf_small), QUERIES[name], SQL[name], sf_small) is None


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(docs, size):
    rows = [(r.doc_id, words(r.text)) for r in docs.collect() if r.doc_id is not None]
    sets = [(i, {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
            for i, w in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    got = near_dups.near_duplicates(docs, size=size).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {
        (i, len(s), find(i)) for i, s in sets}
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_components_of_a_chain_and_a_star(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, k) for k in range(200, 260)],
                                  "a long, b long")
    got = dict(components(links).collect())
    assert got == {k: 0 for k in range(21)} | {100: 100} | {k: 100 for k in range(200, 260)}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    b = np.concatenate((a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)))
    sets = [a, np.unique(b), a[:1]]
    sketch = near_dups.sketches(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))))
    assert (sketch != np.uint64(2**64 - 1)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 300 / 500) < 0.2


def test_tiles_find_reordered_passages():
    item = np.arange(1, 31, dtype=np.uint64)
    doc = np.concatenate((item[15:], [np.uint64(99)], item[:15]))
    found = decontaminate.tiles(doc, np.zeros(len(doc), dtype=bool), item, 5)
    assert sum(n for _, _, n in found) == 30 and len(found) == 2


def test_leaks(spark, docs):
    passage = " ".join(f"q{k}" for k in range(20))
    half = " ".join(f"q{k}" for k in [*range(12, 20), 50, *range(0, 8)])
    more = spark.createDataFrame([(900, "x y " + passage.upper() + " z", "", "", 0, ""), (901, half, "", "", 0, ""),
                                  (902, " ".join(f"q{k}" for k in range(6)), "", "", 0, ""),
                                  (None, passage, "", "", 0, "")], DOCS)
    bench = spark.createDataFrame([(1, passage), (2, "too short"), (3, None), (1, passage)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.covered) for r in decontaminate.leaks(docs.unionByName(more), bench).collect()}
    assert got == {(900, 1, 20), (901, 1, 16), (None, 1, 20)}
    left = decontaminate.without_leaks(docs.unionByName(more), bench)
    assert left.columns == docs.columns and left.where("doc_id >= 900").count() == 1


def test_mixture_meets_targets(docs):
    mix = mixing.mixture(docs)
    rows = mix.taken().collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    drawn = mix.rows(docs)
    assert drawn.count() == sum(r.n_draws for r in rows)
    assert sorted(map(tuple, mixing.mixture(docs).taken().collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_targets_are_capped_and_whole():
    given = mixing.targets([("a", 100), ("b", 10), (None, 1000)])
    assert sum(given.values()) == pytest.approx(1110) and given["b"] == 30 and given["a"] <= 300


def test_packing_round_trip(docs):
    texts = collections.Counter((r.doc_id, r.text or "") for r in docs.collect())
    found = collections.defaultdict(list)
    for r in packing.packed(docs, length=64, window=5000).collect():
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[-1] == r.n_tokens
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert positions[a:b].tolist() == list(range(b - a))
            found[doc].append((start, ids[a:b].tolist()))
    encoding = packing.encoder(packing.VOCABULARY).encoding
    for (doc, text), times in texts.items():
        pieces = sorted(found[doc])[::times]
        assert sum((p for _, p in pieces), [])[:-1] == encoding.encode_ordinary(text)


def test_encoder_equals_whole_encoding():
    encode = packing.encoder(packing.VOCABULARY)
    for text in ["", " ", "a  b", "a b c", " lead", "trail ", "x \n y", "x \n\n  y", "it's  fine", "é ü  z", "a\n b \n c"]:
        assert encode(text) == encode.whole(text)


def test_best_fit_decreasing_places_all_segments():
    sizes = np.random.default_rng(2).integers(1, 101, 500)
    rows = packing.best_fit_decreasing(sizes, 100)
    assert sorted(k for row in rows for k in row) == list(range(500))
    assert max(sizes[row].sum() for row in rows) <= 100 and len(rows) <= 1.1 * sizes.sum() / 100 + 1


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "####### \\", "</turn></turn>\n", "", None, "é ###\\###"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)] + [(None, None, None, "x"),
                                                                                   (2, 0, "a: b###", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = sorted(chat.formatted(df).where("conv_id = 1").collect(), key=lambda r: r.turn)
    for r, t in zip(turns, texts, strict=True):
        assert chat.read_turn(r.formatted.encode())[1].decode() == (t or "")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    said = "".join(f"{('user', 'assistant')[k % 2]}\n{t or ''}\n" for k, t in enumerate(texts))
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    loss = "".join(t or "" for t in texts[1::2])
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].turns_sha256 == hashlib.sha256(b"a: b###\ny\n").hexdigest() and got[None].n_turns == 1


def test_licenses(spark):
    df = spark.createDataFrame([(1, "CC-BY cc by! All rights\nreserved"), (2, None), (3, "General  Public License"),
                                (4, "Released under the MIT License."), (4, "Released under the MIT License."),
                                (None, "cc é by")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
                 for r in licenses.scan(df).collect())
    assert got == [(0, 3, 0, None, None, "", ""), (1, 7, 3, 0, 4, "cc-by,reserved", "cc-by,reserved"),
                   (2, 0, 0, None, None, "", ""), (3, 3, 1, 0, 0, "gpl", "gpl"), (4, 5, 0, None, None, "", "mit"),
                   (4, 5, 0, None, None, "", "mit")]


def test_top_k_takes_what_is_usable(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [2.0, 0.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 131072), (0, 2, 1, 32768), (0, 3, 2, 32768)]


def test_line_dedup_edges(docs):
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert (got[105].n_lines, got[105].n_dropped, got[105].text) == (4, 3, "tail")
    assert (got[106].n_lines, got[106].n_dropped, got[106].text) == (1, 1, "")
    assert got[107].n_dropped == 0 and (got[100].n_lines, got[100].text) == (1, "")


def test_surrogates_keep_type_and_coreference(spark):
    df = spark.createDataFrame([
        (1, "Anna Miller <ANNA@Mail.example.com> anna@mail.example.com +1 (456) 555-2186, 10.20.30.40."),
        (2, "ANNA MILLER 4111 1111 1111 1111 and 4111111111111111"), (3, None), (4, ""), (5, "plain text 12")],
        "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replaced(df).collect()}
    assert "Anna Miller" not in got[1].text and "555-2186" not in got[1].text and "10.20.30.40" not in got[1].text
    mails = re.findall(r"[\w.]+@[\w.]+", got[1].text)
    assert mails[0].lower() == mails[1] and mails[0][:4].isupper()
    assert got[2].text.split(" 4")[0].lower() == got[1].text.split(" <")[0].lower()
    spaced, plain = re.findall(r"[\d ]{16,}", got[2].text)
    assert spaced.replace(" ", "") == plain.strip() != "4111111111111111"
    assert (got[3].text, got[4].text, got[5].text) == (None, "", "plain text 12")


def test_secrets_of_any_length_are_replaced_whole(spark):
    long = "".join(hashlib.sha512(str(k).encode()).hexdigest() + "-" for k in range(40))
    secrets = ["k3y", "p", "***", "abcde", "x" * 256 + "rest", long]
    df = spark.createDataFrame([(k, f"set password: {s} and \"token='{s}' end") for k, s in enumerate(secrets)],
                               "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replaced(df).collect()}
    seen = set()
    for k, secret in enumerate(secrets):
        first, second = re.fullmatch(r"set password: (\S+) and \"token='(\S+)' end", got[k].text).groups()
        assert first == second and first not in secrets and (got[k].n_entities, got[k].kinds) == (2, "secret")
        assert len(first) == (len(secret) if len(secret) >= 6 else 12) and secret[-4:] not in first[-4:]
        seen.add(first)
    assert len(seen) == len(secrets)


def test_surrogates_are_distinct(spark):
    entities = spark.range(3000).select(F.lit("ssn").alias("kind"), F.format_string(
        "%03d-%02d-%04d", F.col("id") % 10, F.lit(0), F.col("id")).alias("normal"))
    got = pii.surrogates(entities).collect()
    assert len({r.surrogate for r in got}) == 3000 and not {r.surrogate for r in got} & {r.normal for r in got}


def test_quality_learns_and_handles_edges(spark, docs):
    toxic = [(200 + k, f"w{k} w{k + 1} nasty v{k} u{k}", "en", None, 0, "") for k in range(60)]
    clean = [(300 + k, f"w{k} w{k + 1} lovely v{k} u{k}", "en", "s1", 0, "") for k in range(60)]
    every = docs.unionByName(spark.createDataFrame(toxic + clean, DOCS))
    labels = spark.createDataFrame([(200 + k, 1, 1) for k in range(40)] + [(300 + k, 1, 0) for k in range(40)]
                                   + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.verdicts(every, labels).collect()}
    assert not any(got[200 + k] for k in range(60)) and all(got[300 + k] for k in range(60))
    assert quality.accepted(every, labels).columns == docs.columns
    assert quality.verdicts(docs, labels.limit(0)).where("NOT keep").count() == 0


def test_quality_is_fitted_on_every_labelled_row(spark):
    """Rows that share a passage are no copies: a fit on one of them would know neither word."""
    run = " ".join(f"shared{k}" for k in range(30))
    texts = [f"{run} {'nasty' if k % 2 else 'lovely'} v{k} u{k} t{k}" for k in range(80)]
    texts += ["foul" if k % 2 else "fine" for k in range(80)]
    rows = spark.createDataFrame([(k, t, "en", "s", 0, "") for k, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(160)], "doc_id long, quality int, toxic int")
    model = quality.fit(rows, labels)
    toxic = quality.evidence(pa.array([f"{run} nasty", f"{run} lovely", "foul", "fine"]), model)[:, 0]
    assert toxic[0] > 0 > toxic[1] and toxic[2] > 0 > toxic[3]


def test_quality_is_fitted_on_whole_texts(spark):
    """A word that tells bad texts is found in texts of many words, whatever its hash."""
    filler = " ".join(f"{k}w{k}" for k in range(1500))
    marks = {bad: [f"{name}{k}{name}" for k in range(10)] for bad, name in enumerate(("lovely", "nasty"))}
    texts = [f"{filler} v{k} {' '.join(marks[k % 2])}" for k in range(40)]
    rows = spark.createDataFrame([(k, t, "en", "s", 0, "") for k, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    model = quality.fit(rows, labels)
    known = set(model.vocabulary.tolist())
    hashes, _ = quality.words(pa.array([" ".join(marks[0] + marks[1])]), quality.ALNUM)
    assert set(hashes.tolist()) <= known
    toxic = quality.evidence(pa.array(texts), model)[:, 0]
    assert (toxic[1::2] > 0).all() and (toxic[::2] < 0).all()


def test_pipeline_stages_in_order(spark, sf_small):
    """Every stage on the rows that the one before left."""
    rows, at = {}, table(spark, sf_small, "documents")
    given = at
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = at = stored(stage(spark, at, sf_small), name)
        if name != "token_packing":
            rows[name] = at.select("doc_id", "text").collect()
    ids = {name: collections.Counter(r.doc_id for r in found) for name, found in rows.items()}
    verdicts = quality.verdicts(given, table(spark, sf_small, "labels")).where("keep")
    assert ids["quality_classifier"] == collections.Counter(r.doc_id for r in verdicts.collect())

    sets = {r.doc_id: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
            for r in rows["quality_classifier"] for w in [words(r.text)]}
    group = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
            low, high = sorted((group[i], group[j]))
            group = {k: low if g == high else g for k, g in group.items()}
    assert set(ids["near_dedup"]) == set(group.values()) and max(ids["near_dedup"].values()) == 1

    leaked = decontaminate.leaks(frames["near_dedup"], table(spark, sf_small, "benchmark")).collect()
    assert set(ids["benchmark_decontamination"]) == set(ids["near_dedup"]) - {r.doc_id for r in leaked}
    drawn = mixing.mixture(frames["benchmark_decontamination"]).taken().collect()
    assert ids["source_mixing"] == collections.Counter({r.doc_id: r.n_draws for r in drawn if r.n_draws})

    encoding = packing.encoder(packing.VOCABULARY).encoding
    size = collections.Counter()
    for r in frames["token_packing"].select("doc_ids", "cu_seqlens").collect():
        for k, doc in enumerate(r.doc_ids):
            size[doc] += r.cu_seqlens[k + 1] - r.cu_seqlens[k]
    want = collections.Counter()
    for r in rows["source_mixing"]:
        want[r.doc_id] += len(encoding.encode_ordinary(r.text or "")) + 1
    assert size == want


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert near_dups.near_duplicates(none).count() == 0
    assert packing.packed(none).count() == 0
    assert mixing.mixture(none).taken().count() == 0
    assert line_dedup.without_repeated_lines(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert pii.replaced(none).count() == 0
