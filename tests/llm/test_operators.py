"""Corpus operators against plain versions, on hard small tables: nulls, empty and long texts, ties, copies, extra columns."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tests.llm import brute
from tidemark.llm import exact_dedup, jaccard, mixing, ngram_lm, pieces_codec, pii, quality, suffix_dedup, url_filter, warc
from tidemark.llm._text import pieces
from tidemark.llm.components import connected_components

DDL = "doc_id long, text string, lang string, source string, n_chars long, id string, hash string, kept string, class string"


def table(spark, rows):
    """Documents with extra columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", 0, "x", "x", "x", "x") for i, t in rows], DDL)


def texts(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)] + ["É", "ß", "naïve"]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 90))] for _ in range(8)]
    rows = []
    for i in range(70):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.3:
            words += r.choice(base)[:30]
        rows.append((i, " ".join(w.upper() if r.random() < 0.05 else w for w in words)))
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows += [(200 + i, f"start {i} {passage} end {i}\n{passage}") for i in range(6)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "a b"), (304, "A  b"), (305, "a" * 3000), (306, rows[0][1]), (307, rows[0][1]), (308, "ab " * 400), (309, "x" * 99), (310, "x" * 99)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, texts()).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def found(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("shallow", [8, 32])
def test_suffix_dedup(docs, shallow):
    got = suffix_dedup.suffix_dedup(docs, shallow=shallow)
    assert found(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_dedup(texts())
    for r in got.collect():
        body = next((t or "").encode() for i, t in texts() if i == r["doc_id"])
        for s in reversed(r["spans"]):
            body = body[: s["start"]] + body[s["end"] :]
        assert bytes(r["kept"]) == body


def test_suffix_dedup_repeated_and_null_ids(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh") for _ in range(300))
    rows = [(None, long), (5, long), (5, long), (6, long + "tail"), (6, "short")]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffix_dedup.suffix_dedup(table(spark, rows)).collect())
    assert got == [(-1, 0), (5, 300), (5, 300), (6, 0), (6, 300)]


def test_deep_shallow_order():
    data = np.frombuffer(b"banana bandana banana bandana banana cabana " * 3 + bytes(40), np.uint8)
    starts = np.arange(100)
    order, equal = suffix_dedup.deep_shallow_sort(data, starts, 33, 8)
    keys = [data[s : s + 33].tobytes() for s in starts[order]]
    assert keys == sorted(keys)
    assert equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


@pytest.mark.parametrize(("length", "shallow"), [(40, 8), (40, 16), (33, 32), (100, 32), (37, 64), (9, 16)])
def test_deep_shallow_order_of_many(length, shallow):
    r = np.random.default_rng(length)
    words = [bytes(r.integers(97, 100, 60, np.uint8)) for _ in range(6)]
    data = np.frombuffer(b"".join(words[i] for i in r.integers(0, 6, 40)) + bytes(length), np.uint8)
    starts = r.permutation(len(data) - length)
    order, equal = suffix_dedup.deep_shallow_sort(data, starts, length, shallow)
    keys = [data[s : s + length].tobytes() for s in starts[order]]
    assert sorted(order.tolist()) == list(range(len(starts))) and keys == sorted(keys)
    assert equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_exact_dedup(docs):
    rows = texts()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(brute.AZ), []).append(i)
    for keep, pick in (("largest", max), ("smallest", min)):
        expected = {i: (pick(g), len(g), i == pick(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
        assert found(exact_dedup.exact_dedup(docs, keep=keep), "keep_id", "group_size", "kept", "text_sha256") == expected


def test_quality(docs):
    expected = {i: brute.quality(t) for i, t in texts()}
    got = {r["doc_id"]: r.asDict() for r in quality.quality_rules(docs).collect()}
    for i, m in expected.items():
        assert {k: got[i][k] for k in m} == m
        failed = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        assert got[i]["base_failed"] == failed
        assert got[i]["kept"] == (not failed and m["n_long_repeat_words"] <= 0.15 * m["n_words"] and m["longest_repeat"] <= 60)
    assert {r["doc_id"] for r in quality.quality_filter(docs).collect()} == {i for i in got if got[i]["kept"]}


def test_suffix_array_is_sorted():
    r = random.Random(2)
    words = np.array([r.randrange(2) for _ in range(120)], np.uint64)
    docs = np.repeat([0, 1], 60)
    suffixes, common = quality.suffix_array(words, docs, 2)
    tails = [tuple(words[s : 60 if s < 60 else 120].tolist()) for s in suffixes]
    for i in range(1, len(tails)):
        same = (suffixes[i] < 60) == (suffixes[i - 1] < 60)
        k = 0
        while same and k < min(map(len, tails[i - 1 : i + 1])) and tails[i][k] == tails[i - 1][k]:
            k += 1
        assert common[i] == (k if k >= 2 else 0)


@pytest.mark.parametrize("block", [1024, 8])
def test_jaccard(docs, block):
    assert found(jaccard.jaccard_join(docs, block=block), "n_shingles", "component_id", "n_links") == brute.jaccard(texts())


def test_jaccard_in_a_cluster_of_many_sizes(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(8 + 3 * i))) for i in range(60)] + [(100 + i, " ".join(f"w{j}" for j in range(40 + i % 7)) + f" x{i}") for i in range(40)]
    df = table(spark, rows)
    want = brute.jaccard(rows)
    assert found(jaccard.jaccard_join(df, block=4), "n_shingles", "component_id", "n_links") == want
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 300)  # blocks are bounded by n-grams, too
    assert found(jaccard.jaccard_join(df), "n_shingles", "component_id", "n_links") == want


@pytest.mark.parametrize("hot", [1, 1000])
def test_jaccard_with_a_passage_in_all_texts(spark, monkeypatch, hot):
    # hot 1: no n-gram is dealt by class; 1000: those of the passage are, and no range has many of the classes.
    monkeypatch.setattr(jaccard, "HOT", hot)
    passage, r = " ".join(f"b{j}" for j in range(20)), random.Random(4)
    rows = []
    for i in range(200):
        own = [f"o{i}x{j}" for j in range(r.randint(1, 12))]
        rows += [(3 * i, f"{passage} {' '.join(own)}"), (3 * i + 1, f"{passage} {' '.join(own[:-1] + ['z'] * (i % 3))}")]
    df = table(spark, rows).repartition(3)
    assert found(jaccard.jaccard_join(df), "n_shingles", "component_id", "n_links") == brute.jaccard(rows)
    grams, _ = jaccard.hot_grams(df, 5, 80)
    assert (len(grams) > 0) == (hot == 1000)
    packed = df.select("text").mapInArrow(jaccard._prefix_rows(8, 5, 80, grams), "bucket int, data binary").collect()
    largest = {b: len(jaccard._decode([x["data"] for x in packed if x["bucket"] == b])[0]) for b in {x["bucket"] for x in packed}}
    by_class = [k for b, k in largest.items() if b >= 8]
    assert len(by_class) == (8 if hot == 1000 else 0) and max(by_class, default=0) < 0.25 * len(rows)


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500, 500), (None, 3)] + [(900 + i, 901 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {x: find(x) for x in root}


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.components.HOT", 20)
    pairs = [(5000 + i, 7) for i in range(300)] + [(i + 1, i) for i in range(300, 360)] + [(355, 5100), (9000, 9001), (7, 5003)]
    got = dict(connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect())
    assert got == {**{x: 7 for p in pairs[:360] + [pairs[360]] for x in p}, 9000: 9000, 9001: 9000}


def test_pii(spark):
    rows = [(1, None), (2, ""), (3, "a@b.c_d@e.f é😀 x@y.z a@b"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4"), (5, "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111"), (6, "+1 (258) 555-9170 ++1 2 +123456789012345678"), (7, "1" * 5000 + " " + "a" * 5000), (8, "a@" * 300)]
    r = random.Random(5)
    rows += [(100 + i, "".join(r.choice("ab.@1 4+-(é") for _ in range(r.randint(0, 120)))) for i in range(120)]
    got = found(pii.find_pii(table(spark, rows)), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == {i: tuple(brute.pii(t)) for i, t in rows}


def test_counts_beyond_32_bits(tmp_path):
    past, words = [np.array([5, 5, 7], np.uint64)], np.array([1, 2, 3], np.uint64)
    counts = np.array([1 << 33, 3, 1])
    back = ngram_lm._decode(ngram_lm._encode(past, words, counts), 2)
    assert back[0][0].tolist() == [5, 5, 7] and back[1].tolist() == [1, 2, 3] and back[2].tolist() == counts.tolist()
    table = pa.table({"bucket": pa.array([0], pa.int32()), "data": pa.array([ngram_lm._encode(past, words, counts)], pa.binary())})
    grams = ngram_lm._histories(1, 2, str(tmp_path))(table).to_pylist()[0]
    arrays = np.split(np.load(tmp_path / f"{grams['name']}.npy"), np.cumsum(grams["sizes"])[:-1])
    assert grams["stats"][0] == counts.sum() and sorted(arrays[1].tolist()) == [3, 1 << 33] and (1 << 33) + 3 in arrays[4].tolist()


def test_pii_learns_contexts(spark):
    rows = [(i, f"hello contact: user{i}@mail.example.com bye") for i in range(12)]
    rows += [(100, "x contact: bob-4711-xyz y"), (101, "version: bob-4711-zzz y"), (102, "plain bob-9999-abc")]
    got = found(pii.find_pii(table(spark, rows)), "n_found", "spans")
    assert got[100] == (1, "found:11:23")
    assert got[101] == (0, "") and got[102] == (0, "")


def test_pii_learns_words_on_both_sides(spark):
    rows = [(i, f"please call +1 (132) 555-13{i:02} at once and write to user{i}@mail.example.com if you like") for i in range(20)]
    rows += [(50 + i, f'set token = "{i}a7{i}b93c{i}d55" now') for i in range(8)]
    rows += [(100, "you may call (132) 555-1353 later"), (101, "or write to john@localhost if so"), (102, "the call 5551 of the house 1234567"), (103, 'then token = "s3" or token = "none" ends'), (104, "we call it a 2nd day"), (105, f"call {'9' * 3000} now"), (106, f"token = \"{'x' * 500}7\" now")]
    got = found(pii.find_pii(table(spark, rows)), "n_secret", "n_found", "spans")
    assert got[100] == (0, 1, "found:13:27") and got[101] == (0, 1, "found:12:26")
    assert got[102] == got[103] == got[104] == (0, 0, "")
    assert got[105] == (0, 1, "found:5:3005") and got[106] == (1, 0, "secret:9:510")  # whatever their length
    assert [got[50 + i][0] for i in range(8)] == [1] * 8


def test_pii_scores_follow_the_graph(spark):
    r = random.Random(11)
    for _ in range(3):
        seed = {f"v{i}": int(r.random() < 0.5) for i in range(40)}
        edges = {(f"p{r.randrange(8)}", f"v{r.randrange(40)}"): r.randint(1, 4) for _ in range(120)}
        total = {p: sum(n for (q, _), n in edges.items() if q == p) * r.choice([1, 1, 2]) for p in {p for p, _ in edges}}
        score = {v: float(s) for v, s in seed.items() if any(v == w for _, w in edges)}

        def patterns():
            out = {}
            for p in total:
                mine = {v: n for (q, v), n in edges.items() if q == p}
                if sum(score[v] >= 0.6 for v in mine) >= 3:
                    out[p] = sum(n * score[v] for v, n in mine.items()) / max(total[p], sum(mine.values()))
            return out

        for _ in range(2):
            strength = patterns()
            for v in score:
                miss = np.prod([1 - min(strength[p], 0.999) for p, w in edges if w == v and p in strength])
                score[v] = 1.0 if seed[v] else 1 - miss
        strength = patterns()
        want = {(p, v) for p, v in edges if strength.get(p, 0) >= 0.6 and not seed[v] and score[v] >= 0.6}
        df = spark.createDataFrame([(p, v, seed[v], n, total[p]) for (p, v), n in edges.items()], "pattern string, value string, seed int, n long, total long")
        assert {tuple(x) for x in pii.bootstrap(df, 2, 0.6, 3).collect()} == want
        occurrences = spark.createDataFrame([(p, v, k) for (p, v), n in edges.items() for k in range(n)], "pattern string, value string, k int")
        chosen = pii._chosen(occurrences, df, pii.bootstrap(df, 2, 0.6, 3))
        assert sorted((x["pattern"], x["value"], x["k"]) for x in chosen.collect()) == sorted((p, v, k) for p, v in want for k in range(edges[p, v]))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(docs, order, monkeypatch):
    monkeypatch.setattr(ngram_lm, "MAPS", 2)  # files are mapped anew when more are needed
    got = found(ngram_lm.lm_scoring(docs, order=order), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    expected = brute.lm(texts(), ngram_lm.discounts, order)
    assert got.keys() == expected.keys()
    for i, e in expected.items():
        assert got[i][:4] == e[:4]
        assert got[i][4:] == pytest.approx(e[4:], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_of_one_frequent_word(spark, order):
    # Every second token is one word, so that its n-grams are parted and its histories put together again.
    r = random.Random(21)
    rows = [(i, " ".join(f"the v{r.randrange(60)}" for _ in range(r.randint(5, 30))) + (" the" if i % 3 else "")) for i in range(60)]
    docs = table(spark, rows).repartition(4)
    ranges = ngram_lm.fit(docs, order=order).ranges
    assert max(ranges.parts) > 1 and ranges.parts.sum() <= ranges.n + len(ranges.parts)
    got = found(ngram_lm.lm_scoring(docs, order=order), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, e in brute.lm(rows, ngram_lm.discounts, order).items():
        assert got[i][:4] == e[:4] and got[i][4:] == pytest.approx(e[4:], rel=1e-9)


def test_language_model_beats_unigrams(spark):
    r = random.Random(8)
    rows = [(i, " ".join(f"k{(i + j) % 40}" for j in range(r.randint(20, 60)))) for i in range(150)]
    held = [x for x in ngram_lm.lm_scoring(table(spark, rows)).collect() if x["held_out"]]
    assert sum(x["score"] for x in held) > 0.3 * sum(x["base_score"] for x in held)


def test_sentencepiece(spark):
    import sentencepiece

    r = random.Random(2)
    rows = texts() + [(1000, "  a  b\n\tc "), (1001, "日本語 text ☃ 😀"), (1002, " " * 40 + "a"), (1003, "<s> <0x0A>"), (1004, "é" * 200), (1005, "\x00a")]
    rows += [(2000 + i, "".join(r.choice("abé \n☃the") for _ in range(r.randint(0, 80)))) for i in range(60)]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces_codec.MODEL)
    encoded = pieces_codec.piece_encode(table(spark, rows))
    got = found(encoded, "ids", "n_pieces", "round_trip")
    for i, t in rows:
        ids = library.encode(t or "")
        assert got[i] == (ids, len(ids), True)
    assert {r["doc_id"]: r["text"] for r in pieces_codec.piece_decode(encoded).collect()} == {i: t or "" for i, t in rows}


def test_viterbi_finds_the_best_sum():
    from sentencepiece import sentencepiece_model_pb2

    r = random.Random(6)
    model = sentencepiece_model_pb2.ModelProto()
    for p in ("a", "b", "ab", "ba", "aba", "bb", "abab", "é"):
        model.pieces.add(piece=p, score=-r.random() * 3, type=1)
    model.trainer_spec.model_type = 1
    v = pieces_codec.parse(model)
    scores = {p.piece: p.score for p in model.pieces}

    def best(s):
        return max((scores[s[:k]] + (best(s[k:]) if k < len(s) else 0) for k in range(1, len(s) + 1) if s[:k] in scores and (k == len(s) or best(s[k:]) > -1e9)), default=-1e9)

    for n in (1, 3, 6, 9):
        strings = ["".join(r.choice("ab") for _ in range(n)) for _ in range(20)]
        rows = np.array([list(s.encode()) for s in strings], np.uint8)
        flags, ids = pieces_codec.viterbi(v, rows)
        for s, f, i in zip(strings, flags, ids):
            assert sum(model.pieces[int(x)].score for x in i[f]) == pytest.approx(best(s), rel=1e-5)


def test_fill_shares_out_shortages():
    assert mixing.fill([1, 1, 2], [10, 100, 100], 60) == pytest.approx([10, 50 / 3, 100 / 3])
    assert mixing.fill([1, 0], [10, 100], 30) == pytest.approx([10, 0])  # a weight of 0 leaves a part out
    leaves = [(("a", "x"), 10), (("a", "y"), 100), (("b", "x"), 100)]
    budget = mixing.allocate(mixing.tree_of(leaves), 120, {}, 1)
    assert budget == pytest.approx({("a", "x"): 10, ("a", "y"): 50, ("b", "x"): 60})


def test_warc(spark):
    r = random.Random(1)
    big = ["<p>" + "".join(r.choice("abé\r\n ") for _ in range(1500)) for _ in range(4)]
    rows = [(i, f"http://e.com/{i}", r.choice(big)) for i in range(40)] + [(50, None, None), (51, "", ""), (52, "u v\r\nX: y", "short"), (53, "u", "short")]
    pages = spark.createDataFrame([(*x, "x") for x in rows], "page_id long, url string, html string, kind string").repartition(3)
    archives = warc.write_archives(pages)
    members = warc.normalise_archives(archives)
    got = {int(x["record_id"]): x for x in warc.read_archives(members).collect()}
    assert got.keys() == {x[0] for x in rows}
    for i, _, h in rows:
        body = (h or "").encode()
        head = max(j for j, _, k in rows if (k or "") == (h or ""))
        revisit = len(body) >= 1000 and head != i
        x = got[i]
        assert (x["payload_bytes"], x["payload_digest"], x["intact"]) == (len(body), hashlib.sha1(body).hexdigest(), True)
        assert (x["record_type"], x["refers_to"]) == (("revisit", str(head)) if revisit else ("response", None))


def test_url_filter(spark):
    rows = [(1, "https://bad.net/es/1", "<link rel='canonical' href='https://fine.org/a'>"), (2, "https://fine.org/a", ""), (3, "https://fine.org/a?utm_source=x#top", None), (4, "https://Example.COM/en/x", ""), (5, "https://WWW.example.com/en/x?y", ""), (6, "https://other.org/z", ""), (7, None, None), (8, "", ""), (9, "mailto:x", ""), (10, "http://ok.com/p", '<meta http-equiv="refresh" content="0; url=https://bad.net/fr/2">'), (11, "https://bad.net/fr/2", ""), (11, "https://bad.net/fr/2", "")]
    pages = spark.createDataFrame([(*x, "x") for x in rows], "page_id long, url string, html string, verdict string")
    got = {x["page_id"]: (x["host"], x["rule"], x["verdict"]) for x in url_filter.url_filter(pages, url_filter.RULES).collect()}
    assert got[1] == ("bad.net", "net/es/", "block")
    assert got[2] == ("fine.org", None, "block") and got[3][2] == "block"
    assert got[4] == ("example.com", "example.com/en/", "block") and got[5][1:] == ("www.example.com/en/", "allow")
    assert got[6][2] == "allow" and got[7] == ("", None, "allow") and got[8] == got[9] == ("", None, "allow")
    assert got[10] == ("ok.com", "com/", "allow")
    more = spark.createDataFrame([("https://other.org/z", "https://bad.net/fr/2")], "a string, b string")
    assert {x["page_id"]: x["verdict"] for x in url_filter.url_filter(pages, url_filter.RULES, more).collect()}[6] == "block"


def test_empty_tables(spark, empty):
    nothing = [suffix_dedup.suffix_dedup(empty), exact_dedup.exact_dedup(empty), pieces_codec.piece_encode(empty), quality.quality_rules(empty), mixing.mix_sources(empty, 0.5), jaccard.jaccard_join(empty), pii.find_pii(empty), ngram_lm.lm_scoring(empty)]
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    nothing += [url_filter.url_filter(pages, url_filter.RULES), warc.read_archives(warc.normalise_archives(warc.write_archives(pages)))]
    for df in nothing:
        assert df.collect() == []


def test_null_and_repeated_ids(spark):
    """Rows without an id, or that repeat one with the same or another text, get the values of their own text."""
    texts = ["one two three mail a@b.org", "one two three mail a@b.org", "word " * 12, "other words here call +1 (555) 010-9999 now", "lone", None, "other words here"]
    rows = list(zip([None, None, 7, 7, 7, None, 8], texts, strict=True))
    df = table(spark, rows)
    for op in (exact_dedup.exact_dedup, pieces_codec.piece_encode, quality.quality_rules, jaccard.jaccard_join, pii.find_pii, ngram_lm.lm_scoring, suffix_dedup.suffix_dedup):
        assert op(df).count() == len(rows), op.__name__
    rank = lambda found: sorted(found, key=repr)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces_codec.MODEL)
    encoded = [(r["doc_id"], r["ids"]) for r in pieces_codec.piece_encode(df).collect()]
    assert rank(encoded) == rank((i, library.encode(t or "")) for i, t in rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]
    measured = [(r["doc_id"], *(r[c] for c in names)) for r in quality.quality_rules(df).collect()]
    assert rank(measured) == rank((i, *(brute.quality(t)[c] for c in names)) for i, t in rows)
    private = [(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.find_pii(df).collect()]
    assert rank(private) == rank((i, *brute.pii(t)) for i, t in rows)


def test_archives_with_null_and_repeated_ids(spark):
    same, other = "x" * 1200, "y" * 1300
    rows = [(None, "u", same), (3, "u", same), (3, "u", other), (5, "u", other), (None, "v", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.read_archives(warc.normalise_archives(warc.write_archives(df))).collect()
    assert sorted((r["record_id"], r["payload_bytes"]) for r in found) == [("3", 1200), ("3", 1300), ("5", 1300), ("None", 0), ("None", 1200)]
    assert {r["record_type"] for r in found} <= {"response", "revisit"}


def test_pieces_cut_batches():
    rows = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 40, None, "", "b" * 5, "c" * 90, "d"])], names=["doc_id", "text"])
    cut = list(pieces(iter([rows]), limit=50))
    assert sum(len(p) for p in cut) == 6 and b"".join(p.data.tobytes() for p in cut) == b"a" * 40 + b"b" * 5 + b"c" * 90 + b"d"
