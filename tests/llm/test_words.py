"""Ranked search, SentencePiece and spelling variants against brute force and the library."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import WORDS, prose

from catalogmatch.llm import pieces, ranking, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, k=20):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in {*items}:
        found = []
        for doc_id, c, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **how):
    rows = ranking.ranked_search(docs, items, **how).select("item_id", "rank", "doc_id", "score").collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(len(WORDS))], k=rng.randrange(1, 60)))) for k in range(900)]
    rows += [(2_000 + k, "alpha beta gamma") for k in range(400)] + [(7, "Alpha, ALPHA!")] * 2  # one hot group, ties, repeated rows
    return rows


ITEMS = [(1, "alpha beta gamma"), (2, "Omega psi. psi chi-chi"), (3, ""), (4, None), (5, "nowhere"), (1, "another text of item one: omega"), (6, "alpha " * 3 + " ".join(WORDS)), (6, "alpha " * 3 + " ".join(WORDS))]


def test_search_equals_brute_force(spark, corpus, odd, monkeypatch):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_search(corpus, [(i, t or "") for i, t in ITEMS])
    assert searched(spark, docs, items) == want
    monkeypatch.setattr(ranking, "FEW", 2)  # masks are told apart down to pairs of documents
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, items_a_pass=2) == want
    assert searched(spark, docs.repartition(24), items, first_blocks=2) == want
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    queries = [(1, "same text TWICE"), (2, "два ß 日本語 ９ a"), (3, rows[-1][1][:300])]
    assert searched(spark, odd, spark.createDataFrame(queries, "item_id long, text string")) == brute_search(rows, queries)


def test_blocks_are_closed_by_documents_and_postings(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    vocabulary = spark.sparkContext.broadcast({t: k for k, t in enumerate([b"alpha", b"beta"])})
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 100)
    index = ranking.blocks(docs, vocabulary)
    assert index.count() == 14 and index.selectExpr("sum(size(ids))").first()[0] == len(corpus)
    assert searched(spark, docs, items) == brute_search(corpus, [(i, t or "") for i, t in ITEMS])


def test_search_of_empty_tables_and_clashing_columns(spark, none, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.ranked_search(none, items).count() == 0
    assert ranking.ranked_search(odd, items.limit(0)).count() == 0
    assert ranking.ranked_search(odd.where("text IS NULL OR text = ''"), items).count() == 0
    other = spark.createDataFrame([("a", "alpha", 1, 2, 3), ("b", "beta", 1, 2, 3)], "doc_id string, text string, item int, rank int, score long")
    clash = items.selectExpr("*", "1 AS doc_id", "2 AS rank", "3 AS score")
    assert {tuple(r)[:3] for r in ranking.ranked_search(other, clash).where("item_id = 6").collect()} == {(6, 1, "a"), (6, 2, "b")}


def test_very_long_texts_are_read_whole(spark, monkeypatch):
    text = "alpha " + "x" * 3_000 + " " + prose(3, 400) + " omega"
    whole = list(ranking.terms_of(text))
    runs = [w for part in variants.runs_of(text + " Ünïcode ÀÉÿ×abc", 7) for w in part]
    monkeypatch.setattr(ranking, "_PART", 50)
    monkeypatch.setattr(variants, "_PART", 50)
    assert [t for part in ranking.terms_of(text) for t in part] == whole[0] == [t.encode() for t in terms(text)]
    assert [w for part in variants.runs_of(text + " Ünïcode ÀÉÿ×abc", 7) for w in part] == runs
    assert runs[-2:] == ["Ünïcode".encode("latin-1"), "ÀÉÿ×abc".encode("latin-1")]


# SentencePiece


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def agenda(model):
    with open(model, "rb") as file:
        return pieces.Agenda(file.read())


def test_ids_and_texts_equal_the_library(agenda):
    rng = random.Random(5)
    texts = ["", " ", "  ", "   a", "a  b   c    d", "\n", "\n\n a", "▁", "▁▁ x", "<s>", "</s> hi", "<0x41>", "a\x00b", "中" * 500, "x" * 2000, "\t\t", "m² (a).", "“q”\r\n", "\U0010ffff", " " * 700 + "z", "aGVsbG8" * 300]
    texts += ["".join(rng.choice("aeinrst  ▁\n,.()中é🙂0<>²'") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(80, 300))) for _ in range(60)]
    ids = agenda.encode(texts)
    assert [x.tolist() for x in ids] == agenda.library.encode(texts, add_eos=True)
    assert [agenda.decode(x) for x in ids] == [agenda.library.decode(x.tolist()) for x in ids]
    for _ in range(1500):
        some = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.randrange(3)]) for _ in range(rng.randrange(8))]
        assert agenda.decode(np.array(some, np.int64)) == agenda.library.decode(some)


def test_agendas_side_by_side_and_heaps_agree(agenda, monkeypatch):
    rng = random.Random(8)
    chunks = ["▁" + "".join(rng.choice("aeiourstln'é") for _ in range(rng.randrange(0, 90))) for _ in range(400)] + ["▁" * n for n in range(1, 40)]
    ids, lengths = agenda.replay(chunks)
    monkeypatch.setattr(pieces, "LONG", 0)
    again = agenda.replay(chunks)
    assert ids.tolist() == again[0].tolist() and lengths.tolist() == again[1].tolist()


def test_a_difference_from_the_library_is_an_error(model):
    with open(model, "rb") as file:
        wrong = pieces.Agenda(file.read())
    v = wrong.vocabulary
    v.ranks = v.ranks[::-1].copy()
    with pytest.raises(ValueError, match="differ"):
        wrong.encode(["internationalisation of the encoders"])


def test_chunks_are_forgotten_and_texts_taken_in_parts(agenda, model, monkeypatch):
    with open(model, "rb") as file:
        small = pieces.Agenda(file.read(), most_chunks=5)
    texts = [prose(k, 300) for k in range(6)]
    assert [x.tolist() for t in texts for x in small.encode([t])] == agenda.library.encode(texts, add_eos=True)
    monkeypatch.setattr(pieces, "_PART", 64)
    assert [x.tolist() for x in agenda.encode(texts)] == agenda.library.encode(texts, add_eos=True)


def test_pieces_of_odd_rows(spark, odd, none, model, agenda):
    got = pieces.encode_pieces(odd, model, decoded=True)
    want = sorted((str(r.doc_id), agenda.library.encode(r.text or "", add_eos=True), r.text or "") for r in odd.collect())
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got.collect()) == want
    assert sorted((str(r.doc_id), r.decoded) for r in pieces.decode_pieces(got, model).collect()) == [(i, t) for i, _, t in want]
    assert pieces.piece_digest(none, model).count() == 0
    assert pieces.piece_digest(odd.where("doc_id = 101"), model).first().n_tokens == 1


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="merge type"):
        pieces.Vocabulary(b"\x12\x02\x18\x01")


# Spelling variants


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def brute_variants(words):
    near = {w: set() for w in words}
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((k, w[:k], w[k + 1 :]), set()).add(w)
    for w in words:
        for k in range(len(w)):
            near[w] |= holes[k, w[:k], w[k + 1 :]] - {w}
            if (x := w[:k] + w[k + 1 :]) in words:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w, found in near.items():
        if found and words[best := min(found, key=lambda x: (-words[x], x))] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


def varied(spark, words, **how):
    made = spark.createDataFrame(sorted(words.items()) or [], "word string, n long")
    return sorted(map(tuple, variants.spelling_variants(made, **how).collect()), key=repr)


def test_words_of_the_corpus(spark, odd, none):
    rng = random.Random(4)
    stock = ["Internat", "naïveté", "ÉCLAIRS", "straßenbahn", "encyclopaedia", "short", "×÷×÷×÷×", "parallel"]
    rows = [(k if k % 9 else None, " ".join(rng.choices(stock, k=80)) + " Āparallelo 日本parallels") for k in range(120)] + [(3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in variants.corpus_words(docs).where("n >= 2").collect()} == brute_words(rows)
    assert {r.word: r.n for r in variants.corpus_words(odd).where("n >= 2").collect()} == brute_words([(r.doc_id, r.text) for r in odd.collect()])
    assert variants.corpus_words(none).count() == 0


@pytest.mark.parametrize("partitions", [3, 4, 6])
def test_variants_equal_brute_force(spark, partitions):
    rng = random.Random(partitions)
    words = {"aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaab": 500, "abcdefg": 7, "abcdefgh": 70, "bacdefg": 70, "xbcdefg": 70, "ñandúes": 9, "nandúes": 90}
    for _ in range(60):
        base = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(7, 12)))
        words[base] = rng.choice([3, 100, 10_000])
        for _ in range(12):
            k, c = rng.randrange(len(base)), rng.choice("aeiourstñ")
            edited = rng.choice([base[:k] + c + base[k + 1 :], base[:k] + c + base[k:], base[:k] + base[k + 1 :]])
            if len(edited) >= 7:
                words.setdefault(edited, rng.choice([2, 3, 30, 1000]))
    assert varied(spark, words, partitions=partitions) == brute_variants(words)


def test_chains_lead_to_their_last_form_and_hot_words_lose_none(spark):
    chain = {"a" * (7 + k): 10**k * 2 for k in range(9)}
    got = varied(spark, chain)
    assert got == brute_variants(chain) and all(r[2] == "a" * 15 for r in got)
    hot = {f"parallel{a}{b}": 2 for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"} | {"parallel": 10_000, "parallela": 100}
    assert varied(spark, hot) == brute_variants(hot)
    assert varied(spark, {}) == []
    assert varied(spark, {"lonelyword": 3}) == [("lonelyword", None, "lonelyword", 3, 0, None)]
