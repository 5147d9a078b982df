"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from lodestrata.llm import ann, host_rules, langid, mixing, passages, pieces, simhash, tokens, toxicity, warc
from lodestrata.llm.common import connected_components, cut

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Size int, key string, h string, word string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "s", "ing"]) for _ in range(n))


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, text_of(rng, rng.randint(1, 120)), rng.choice(["en", "de"]), f"s{i % 4}"))
    rows += [(n, None, "en", "s0"), (n + 1, "", "en", None), (n + 2, rows[3][1], "en", "s1"), (n + 3, rows[3][1].upper(), None, "s1"), (n + 4, " \n\t ", "en", "s1"), (None, "no key here at all", "en", "s2"), (5, rows[5][1], "en", rows[5][3]), (n + 5, "x" * 5000 + " \n" + text_of(rng, 4000), "de", "s3"), (n + 6, "▁ tab\tand\x00nul 漢字 é́ <|endoftext|>", "de", "s3")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "k", "h", "w") for r in corpus()], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def union(n, links):
    to = list(range(n))

    def find(a):
        while to[a] != a:
            a = to[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        to[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 90)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    want = union(700, links)
    assert got == {x: want[x] for pair in links for x in pair}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_host_rules_against_brute_force(docs, none):
    got = {}
    for r in host_rules.judge(docs).collect():
        got.setdefault(r.key, []).append(r)
    for i, text, *_ in corpus():
        w = WORD.findall(text or "")
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if twice[x] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert host_rules.judge(none).count() == 0


def test_repeated_windows(spark):
    rows = [(1, "a b c d e f a b c d e g"), (2, "a a a a a a a"), (3, "a b c d"), (4, " ".join("abcde" * 3))]
    got = {r.key: r.n_repeat_words for r in host_rules.measure(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))).collect()}
    assert got == {1: 10, 2: 7, 3: 0, 4: 15}


def test_bad_host_goes(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, good, "fine") for i in range(60)] + [(100 + i, bad, "spam") for i in range(50)] + [(200, good, "spam"), (201, good, None)]
    got = {r.key: r.kept for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(60)) and not got[200] and got[201] and not got[100]


def filled(sizes, weights, most=3):
    """Targets by resharing until none is above its cap."""
    total, t, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while open_:
        level = rest / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] >= most * sizes[i]}
        if not over:
            for i in open_:
                t[i] = level * weights[i]
            break
        for i in over:
            t[i] = most * sizes[i]
            rest -= t[i]
        open_ -= over
    return t


def test_mixing_meets_targets(spark, docs, none):
    rng = random.Random(2)
    rows = [(i, text_of(rng, rng.randint(0, 40)), rng.choices(["a", "b", "c", "d", None], [50, 20, 20, 1, 9])[0]) for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table).collect()
    again = {(r.key, r.copies) for r in mixing.mix(table.repartition(7)).collect()}
    assert again == {(r.key, r.copies) for r in got} and len(got) == len(rows)
    names = ["a", "b", "c", "d", None]
    size = Counter()
    for _, text, s in rows:
        size[s] += len(WORD.findall(text))
    want = dict(zip(names, filled([size[s] for s in names], [1, 2, 3, 1, 2]), strict=True))
    for s in names:
        mine = [r for r in got if r.source == s]
        taken = sum(r.size * r.copies for r in mine)
        assert mine[0].source_size == size[s] and mine[0].target == pytest.approx(want[s])
        assert abs(taken - want[s]) <= 40 and max(r.copies for r in mine) <= 3
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0


def test_token_files_come_back(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = tokens.read_tokens(spark, tokens.write_tokens(docs, path, end_id=2)).collect()
    assert len(got) == docs.count()
    texts = Counter((i, t) for i, t, *_ in corpus())
    at = 0
    keys = [r.key for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    for r in sorted(got, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert r.start == at and len(ids) == r.n_tokens
        assert any(k == r.key and plain.encode(t or "", add_special_tokens=False).ids + [2] == ids for k, t in texts)
        at += r.n_tokens
    assert tokens.read_tokens(spark, tokens.write_tokens(none, path, end_id=2)).count() == 0
    assert tokens.digest(np.array([1, 2], "<u2")) == (zlib.crc32(np.array([1, 2], "<u4").tobytes()),)


def brute_print(text, n=3):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_against_brute_force(docs, none):
    got = {(r.key, r.text_hash): r for r in simhash.near_duplicates(docs).collect()}
    rows = corpus()
    prints = [brute_print(t) for _, t, *_ in rows]
    roots = union(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    for at, (i, *_ ) in enumerate(rows):
        mine = [r for (k, _), r in got.items() if k == i and (r.fp & (1 << 64) - 1) == prints[at]]
        ids = [rows[k][0] for k in range(len(rows)) if roots[k] == roots[at] and rows[k][0] is not None]
        assert mine and mine[0].component == min(ids, default=None)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots)) and simhash.keep_first(none).count() == 0


def test_links_in_crowded_buckets(spark):
    """Groups too large to pair are linked as by brute force."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(260)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for bits in (0, 1, 2):
        links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits).collect()
        place = {s: i for i, s in enumerate(signed)}
        got = union(len(prints), [(place[r.a], place[r.b]) for r in links])
        assert got == union(len(prints), [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= bits])
        assert all((prints[place[r.a]] ^ prints[place[r.b]]).bit_count() <= bits for r in links)


def test_warc_comes_back(spark):
    rows = [(1, "http://a/", "<p>x</p>", 0), (2, None, "<p>x</p>", 0), (3, "http://c/ d\r\nX: y", "<p>é</p>" * 3000, 0), (4, "u", None, 0), (5, "u", "", 0), (None, "u", "<p>x</p>", 0), (2, None, "<p>x</p>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = warc.write_warc(pages)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.pages_of(warc.read_warc(spark, folder)).collect())
    sha = lambda t: warc.base32_digest((t or "").encode())
    want = []
    for page, _, html, _ in rows:
        top = max((p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None), default=None)
        again = top is not None and page != top
        want.append((page or 0, len((html or "").encode()), sha(html), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=lambda x: x[:2] + (x[4] or 0,)) or Counter(got) == Counter(want)
    found = warc.read_warc(spark, folder)
    assert found.where("record_type = 'revisit'").count() == sum(w[3] == "revisit" for w in want)
    assert found.where(F.col("payload_digest") == sha("<p>x</p>")).count() == 4
    assert warc.read_warc(spark, folder, payload=False).agg(F.sum("http_length")).first()[0] == sum(w[1] for w in want)
    small = warc.pages_of(warc.read_warc(spark, warc.write_warc(pages, least_bytes=9))).where("record_type = 'revisit'").count()
    assert small == 0
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0


def test_plain_warc_files(spark, tmp_path):
    """Records of others: uncompressed, and gzip members without a skip length."""
    import gzip

    one, two = warc.record(7, "http://x/", b"body", warc.base32_digest(b"body")), warc.record(8, None, b"b" * 9000, warc.base32_digest(b"b" * 9000))
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    got = warc.pages_of(warc.read_warc(spark, str(tmp_path))).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(7, 4), (7, 4), (8, 9000), (8, 9000)]


def test_language(spark, docs, none):
    rng = random.Random(3)
    en, de = "the and of with this house water time".split(), "der und das mit diese haus wasser zeit".split()
    rows = [(i, text_of(rng, 30, en if i % 2 else de), "en" if i % 2 else "de") for i in range(200)]
    told = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ask = spark.createDataFrame([(1, "the water"), (2, "das wasser"), (3, None), (4, ""), (5, "123 !? ½"), (6, "wassers"), (7, "漢字")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(ask, told).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "und", "und", "und", "de"] and got[7].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(ask, langid.learn(none)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs, told).columns == [*docs.columns, "lang_pred", "score"]


def segments_brute(scores):
    """The best segment, and those left and right of it, all with positive scores."""
    if len(scores) == 0:
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    a, b = best[3], best[4]
    return segments_brute(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in segments_brute(scores[b:])]


def test_segments_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 1000 for _ in range(rng.randint(0, 25))]
        got = [(a, b) for a, b, _ in toxicity.segments(np.array(scores))]
        assert got == segments_brute(scores)


def test_toxicity(spark, docs, none):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(600):
        words = text_of(rng, 60).split()
        if bad := i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["slurb", "vilent", "grotch"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.learn(table, labels.where("doc_id < 400"))
    got = {r.doc_id: r for r in toxicity.score(table, model).where("doc_id >= 400").collect()}
    assert all(got[i].toxic == int(i % 5 == 0) for i in got) and all(0 <= r.toxicity <= 1 for r in got.values())
    assert all(len(got[i].passages) > 0 for i in got if i % 5 == 0)
    out = toxicity.score(docs, model)
    assert out.where("toxic = 1").count() == 0 and out.columns[: len(docs.columns)] == docs.columns
    empty = toxicity.learn(none, labels.limit(0))
    assert toxicity.score(table, empty).where("toxic = 1").count() == 0 and toxicity.score(none, model).count() == 0


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:400] = x[100]  # a third of the rows are one vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0, None] * 8, 1), (None, [1.0] * 16, 1), (2080, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.search(table, table.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    exact, hit = x.astype(float) @ x.astype(float).T, 0
    assert got.keys() == set(range(0, 900, 20))
    for q, found in got.items():
        order = [i for i in np.lexsort((np.arange(900), -exact[q])) if i != q][:10]
        ids = [found[k][0] for k in range(1, 11)]
        hit += len(set(ids) & set(order))
        assert all(found[k][1] == pytest.approx(exact[q][found[k][0]], abs=1e-12) for k in found)
        assert [(-found[k][1], found[k][0]) for k in range(1, 11)] == sorted((-s, i) for i, s in found.values())
    assert hit / (10 * len(got)) >= 0.9
    for r in ann.search(table, table.where("vec_id % 20 = 0"), 10, recall=None).collect():
        order = [i for i in np.lexsort((np.arange(900), -exact[r.query_id])) if i != r.query_id]
        assert r.score == pytest.approx(exact[r.query_id][order[r.rank - 1]], abs=1e-12)
    few = table.where("vec_id < 3")
    assert ann.search(few, few, 10).count() == 6 and ann.search(table.limit(0), table, 10).count() == 0


def test_nearest_among_tight_groups_and_wide_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 32)) * 3  # wide rows, which the codes are spent on
    tight = rng.random(6000) < 0.7
    x[tight] = rng.standard_normal((5, 32))[rng.integers(5, size=tight.sum())] + rng.standard_normal((tight.sum(), 32)) * 0.01
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(table, table.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    exact = x @ x.T
    np.fill_diagonal(exact, -np.inf)
    hit = [len(found[q] & set(np.argsort(-exact[q])[:20].tolist())) for q in range(0, 6000, 20)]
    assert sum(hit) / (20 * len(hit)) >= 0.95


def paths(lattice, unit):
    """Every segmentation of a unit with its weight."""
    if not unit:
        return [((), 1.0)]
    out = []
    for k in range(1, len(unit) + 1):
        if unit[:k] in lattice.pieces:
            i, w = lattice.pieces[unit[:k]]
            out += [((i, *rest), math.exp(w) * v) for rest, v in paths(lattice, unit[k:])]
    return out


def test_sampled_pieces_follow_the_lattice():
    model = pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    every = paths(model, " then")
    total = sum(w for _, w in every)
    n = 20_000
    drawn = Counter(tuple(x.tolist()) for x in model.sample(["then"] * n, list(range(n))))
    assert drawn.keys() <= {p for p, _ in every}
    for p, w in every:
        share = w / total
        assert abs(drawn[p] / n - share) < 5 * math.sqrt(share / n) + 1e-4


def boundaries(lattice, text):
    """The exact probability that a piece ends at each place of a text, by sums over all paths in exact fractions of floats."""
    whole = " " + text
    n = len(whole)
    edges = [(i, j, Fraction(math.exp(lattice.pieces[whole[i:j]][1]))) for i in range(n) for j in range(i + 1, min(n, i + 20) + 1) if whole[i:j] in lattice.pieces]
    edges += [(i, i + 1, Fraction(math.exp(lattice.rare)) ** len(c.encode())) for i, c in enumerate(whole) if c not in lattice.pieces]
    ahead, behind = [Fraction(0)] * (n + 1), [Fraction(0)] * (n + 1)
    ahead[0] = behind[n] = Fraction(1)
    for i, j, w in sorted(edges, key=lambda e: e[1]):
        ahead[j] += ahead[i] * w
    for i, j, w in sorted(edges, key=lambda e: -e[0]):
        behind[i] += behind[j] * w
    return [float(ahead[k] * behind[k] / ahead[n]) for k in range(1, n + 1)]


@pytest.mark.parametrize("alpha", [0.3, 1.0, 2.0])
@pytest.mark.parametrize("text", ["then" * 13, "http://the.other/" + "inthenation" * 6 + "漢then" + "is" * 20])
def test_long_parts_follow_the_lattice(alpha, text):
    model = pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"), alpha)
    n, seen = 4000, np.zeros(len(text) + 1)
    for drawn in model.sample([text] * n, list(range(n))):
        raw = np.cumsum([len(model.spelling[i]) for i in drawn])
        ends = np.cumsum([len(c.encode()) for c in " " + text])
        seen += np.isin(ends, raw)
    for got, share in zip(seen / n, boundaries(model, text), strict=True):
        assert abs(got - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-3


def test_parts_are_built_alike_in_any_company(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [r[1] for r in corpus()] + ["a" * 3000, "🙂é then", " ", "\n\n  x"]
    whole = pieces.Lattice(path).sample(texts, list(range(len(texts))))
    monkeypatch.setattr(pieces, "RUN", 50)  # long texts are built piecemeal
    for i, (t, x) in enumerate(zip(texts, whole, strict=True)):
        model = pieces.lattice(path, 1.0)
        assert model.sample([t], [i])[0].tolist() == x.tolist() and model.decode(x) == (t or "")


def test_equal_hashes_do_not_mix_parts(monkeypatch):
    model = pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(pieces, "_mixed", lambda x: x % np.uint64(3))
    points = np.frombuffer(" and the in then and".encode("utf-32-le"), np.uint32)
    starts = np.array([0, 4, 8, 11, 16])
    chosen, which = model.distinct(points, starts, np.array([4, 4, 3, 5, 4]))
    at = [" and", " the", " in", " then", " and"]
    assert [at[chosen[w]] for w in which] == at


def test_pieces_are_lossless_and_reproducible(spark, docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(docs, path)
    assert coded.where(~pieces.decoded(F.col("pieces"), path).eqNullSafe(F.col("text"))).count() == 0
    same = {(r.doc_id, r.text): bytes(r.pieces or b"") for r in coded.collect()}
    assert same == {(r.doc_id, r.text): bytes(r.pieces or b"") for r in pieces.encode(docs.repartition(5), path).collect()}
    other = {(r.doc_id, r.text): bytes(r.pieces or b"") for r in pieces.encode(docs, path, seed=1).collect()}
    assert same != other and pieces.encode(none, path).count() == 0


def chain_brute(x, y):
    """The best score of a chain that ends in each match."""
    order, best = sorted(range(len(x)), key=lambda i: (x[i], -y[i])), {}
    for i in order:
        before = [best[j] - passages.GAP * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i]]
        best[i] = passages.SEED + max(0.0, max(before, default=0.0))
    return max(best.values(), default=0)


def chain_score(x, y, chain):
    return sum(passages.SEED for _ in chain) - passages.GAP * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(chain, chain[1:], strict=False))


def test_chains_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 25)
        x, y = [rng.randrange(60) for _ in range(n)], [rng.randrange(60) for _ in range(n)]
        got = passages.chains(x, y)
        assert sorted(i for c in got for i in c) == list(range(n))
        assert all(x[a] < x[b] and y[a] < y[b] for c in got for a, b in zip(c, c[1:], strict=False))
        assert max(chain_score(x, y, c) for c in got) == pytest.approx(chain_brute(x, y))


def test_repeated_passages(spark, docs, none):
    rng = random.Random(7)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, fuzzy, short = own(60), own(120), own(30)
    changed = list(fuzzy)
    for at in (25, 60, 95):
        changed[at] = "other"
    rows = [(1, " ".join(own(80) + shared + own(50))), (2, " ".join(own(20) + shared + own(70))), (3, " ".join(fuzzy + own(10))), (4, " ".join(own(33) + changed)), (5, " ".join(own(40) + short)), (6, " ".join(short + own(40))), (7, "\n".join(own(300))), (8, " ".join(shared)), (9, None), (10, "")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    got = {(r.key, r.first_key): r for r in passages.repeated_passages(table).collect()}
    assert got.keys() == {(2, 1), (8, 1), (4, 3)}
    assert (got[2, 1].start, got[2, 1].end, got[2, 1].first_start, got[2, 1].first_end, got[2, 1].matched) == (20, 80, 80, 140, 60)
    assert got[4, 3].start == 33 and got[4, 3].end == 153 and got[4, 3].matched == 117
    left = {r.doc_id: r.text for r in passages.cut_passages(table).collect()}
    before = dict(rows)
    assert left.keys() == before.keys() - {8} and all(left[i] == before[i] for i in (1, 3, 5, 6, 7, 9, 10))
    assert len(left[2].split()) == 90 and len(left[4].split()) == 33
    assert passages.repeated_passages(none).count() == 0 and passages.cut_passages(none).count() == 0
    assert passages.cut_passages(docs).columns == docs.columns


def test_passages_are_cut_in_one_worker_a_task(spark, docs):
    plan = passages.cut_passages(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_lattices_take_little_memory(spark):
    own, rng = pieces.lattice(public_tokenizers.path("piece_bpe_32k.model"), 1.0), random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(50_000)) for _ in range(20)]
    few = [own.sample([t], [i])[0] for i, t in enumerate(texts[:3])]
    tracemalloc.start()
    try:
        many, most = own.sample(texts, list(range(20))), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 120e6  # a million characters
    assert all((a == b).all() for a, b in zip(few, many, strict=False)) and [own.decode(x) for x in many] == texts


@pytest.mark.parametrize("gap", [10, 30, 40, 75, 150, 300])
def test_two_passages_in_one_pair(spark, gap):
    rng = random.Random(gap)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, line = own(60), own(60), own(9)
    rows = [(1, a + own(gap) + b), (2, own(20) + a + own(gap) + b + own(20)), (3, line + own(20) + own(60)), (4, [])]
    rows[3] = (4, line + own(20) + rows[2][1][29:])
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    found = [(r.key, r.start, r.end) for r in passages.repeated_passages(table).orderBy("key", "start").collect()]
    assert found == ([(2, 20, 140 + gap)] if gap <= 30 else [(2, 20, 80), (2, 80 + gap, 140 + gap)]) + [(4, 29, 89)]
    left = {r.doc_id: len(r.text.split()) for r in passages.cut_passages(table).collect()}
    assert left[2] == (40 if gap <= 30 else 40 + gap) and left[4] == 29


def test_passages_whose_seeds_are_first_elsewhere(spark):
    rng = random.Random(11)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    p, q = own(60), own(360)
    parts = lambda: [own(30) + p[:45] + own(30), own(30) + p[15:] + own(30)]
    texts = [*parts(), own(30) + p + own(30), *parts(), own(40) + p + own(10)]
    texts += [own(30) + q[at : at + 45] + own(30) for at in range(35, 335, 20)]
    texts += [own(20) + q + own(20), own(33) + q + own(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = len(rows) - 1
    assert (5, 40, 100, 2) in {(r.key, r.start, r.end, r.first_key) for r in got}
    assert (n, 33, 393, n - 1, 20, 380) in {(r.key, r.start, r.end, r.first_key, r.first_start, r.first_end) for r in got}
    assert {(r.key, r.first_key) for r in got} == {(5, 2), (n, n - 1)}


def test_split_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        runs, i, j = [], 0, 0
        for _ in range(rng.randint(1, 9)):
            i, j, n = i + rng.randint(0, 30), j + rng.randint(0, 30), rng.randint(1, 70)
            runs.append((i, j, n))
            i, j = i + n, j + n
        got = passages.split(runs, 50, 0.8)
        fits = {}
        for s, (i, j, n) in enumerate(runs):
            for e in range(s, len(runs)):
                end, m = runs[e], sum(r[2] for r in runs[s : e + 1])
                if m >= 50 and m >= 0.8 * max(end[0] + end[2] - i, end[1] + end[2] - j) and n >= 4 and end[2] >= 4:
                    fits[i, end[0] + end[2]] = m
        assert all(fits[s, e] == m for s, e, _, _, m in got)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        assert all(any(s < ge and gs < e for gs, ge, *_ in got) for s, e in fits)


def test_cut_words():
    assert passages.without("a b  c\nd", [(1, 3)]) == "a d" and passages.without(" a b", [(0, 1)]) == " b" and passages.without("a b", [(0, 2)]) == ""
    assert passages.without("é a b", [(1, 2), (0, 2)]) == "b" and passages.without(None, [(0, 1)]) is None


def test_bounded_samples(spark):
    """Never over the bound, whole where it fits, and also where one key has most rows."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    for bound in (5000, 1500, 100, 1):
        n = langid.bounded(rows, F.col("k"), bound).count()
        assert n <= bound and (n == 3000 if bound == 5000 else n >= bound // 2)
    one = spark.range(500).select(F.lit(None).cast("long").alias("k"))
    assert langid.bounded(one, F.col("k"), 50).count() == 50
    assert langid.bounded(one.limit(0), F.col("k"), 50).count() == 0


def shingle_set(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(w)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_contested_signatures_against_brute_force(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64), rng.getrandbits(64)]
    flips = [(0, 1 << 3), (0, 1 << 40), (1, 1 << 20), (1, 1 << 44)]  # a family of near copies: few values of each segment
    fps = [[w ^ sum(b for k, b in flips if k == i and rng.random() < 0.4) for i, w in enumerate(base)] for _ in range(120)] + [[rng.getrandbits(64), rng.getrandbits(64)] for _ in range(40)]
    signed = [[w - (1 << 64) if w >> 63 else w for w in f] for f in fps]
    rows = spark.createDataFrame([(i, f, i // 2) for i, f in enumerate(signed)], "node long, fp array<long>, c long")
    words = [F.col("fp")[k] for k in range(2)]
    all_of = simhash.marked(rows, words, 9, "node", "c")
    plain = rows.select("node", F.explode(simhash.signatures(words, 9)).alias("k"))
    assert sorted(map(tuple, all_of.select("node", "k").collect())) == sorted(map(tuple, plain.collect()))
    under = all_of.join(simhash.contested(all_of), "k").collect()
    by = {}
    for r in under:
        by.setdefault(r.k, []).append((r.node, r.c))
    got = {(i, j) for some in by.values() for i, c in some for j, d in some if i < j and c != d}
    cuts = simhash.bounds(9, 128)
    whole = [f[0] | f[1] << 64 for f in fps]
    near = lambda x: any((x >> at & ((1 << n) - 1)).bit_count() <= 1 for at, n in cuts)
    assert got == {(i, j) for j in range(160) for i in range(j) if i // 2 != j // 2 and near(whole[i] ^ whole[j])}
    assert len(under) <= 120 * (len(cuts) + 2 * len(flips))  # of 128 a fingerprint


def test_similar_against_brute_force(spark, docs, none):
    rng = random.Random(4)
    bases = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(80, 300))) for _ in range(60)]
    texts = bases + [edited(rng, b, rng.randint(0, 6)) for b in bases for _ in range(3)]
    texts += [edited(rng, bases[0], rng.randint(1, 5)) for _ in range(150)]  # a crowd, all different
    texts += [None, "", " \n", "One two", "one  TWO", "one two three", bases[1].upper(), bases[1]]
    rng.shuffle(texts)
    rows = [(i, t, "a", "b", 1, 7, "k", "h", "w") for i, t in enumerate(texts)] + [(None, bases[2], "a", "b", 1, 7, "k", "h", "w"), (3, texts[3], "a", "b", 1, 7, "k", "h", "w")]
    table = spark.createDataFrame(rows, SCHEMA)
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = union(len(texts), links)
    for sure_bits, recall, in_crowd in ((11, 0.9, 0.95), (simhash.SURE_BITS, 0.9, 0.8)):
        found = simhash.similar(table, sure_bits=sure_bits)
        got = {r.key: r.component for r in found.where("key IS NOT NULL").collect()}
        assert got.keys() == set(range(len(texts)))
        assert all(roots[i] == roots[c] for i, c in got.items())  # nothing is linked that isn't alike
        hit = sum(got[i] == got[j] for i, j in links) / len(links)
        crowd = Counter(got.values()).most_common(1)[0][1] / max(Counter(roots).values())
        print(f"{sure_bits} bits: {hit:.3f} of {len(links)} links, {crowd:.3f} of the crowd")
        assert hit >= recall and crowd >= in_crowd
    kept = simhash.keep_first(table, found=found)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert simhash.similar(none).count() == 0 and simhash.similar(docs).count() >= docs.select("doc_id", "text").distinct().count()


def test_names_of_inputs_cannot_clash(spark):
    """Columns named as the operators' own, or their results, come back as they were."""
    names = ["_again", "_s", "_first_key", "_k", "_t", "_left", "_mk", "_mh", "_mc", "_toxicity", "toxicity", "toxic", "passages", "score", "lang_pred", "row", "took", "hash", "first", "cut", "copies", "text_hash", "told", "found"]
    rng = random.Random(8)
    rows = [(i, text_of(rng, 80), "en", "s", *range(100, 100 + len(names))) for i in range(6)] + [(6, None, "en", None, *range(100, 100 + len(names)))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    told = langid.learn(table.select("doc_id", "text", "lang"))
    outs = [mixing.mixed(table), passages.cut_passages(table), simhash.keep_first(table), simhash.keep_first(table, found=simhash.similar(table)), langid.identify(table, told), toxicity.score(table, toxicity.Model())]
    for out in outs:
        assert out.columns[: len(table.columns)] == table.columns and len(set(out.columns)) == len(out.columns)
        for r in out.collect():
            assert list(r)[4 : 4 + len(names)] == list(range(100, 100 + len(names)))


def test_passages_exact_way_ties_all_holders(spark):
    rng = random.Random(17)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    pieces_ = [own(25) for _ in range(3)]  # each stands alone in six earlier documents, too short for a passage
    rows = [(i, " ".join(t for p in pieces_ for t in (own(30), p, own(30)))) for i in range(6)]
    for i in (20, 21):  # these two share all three, with another word where they meet
        rows.append((i, own(40) + " " + f" {own(1)} ".join(pieces_) + " " + own(40)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.key, r.start, r.end, r.first_key, r.matched) for r in passages.repeated_passages(table, rounds=None).collect()] == [(21, 40, 117, 20, 75)]


def test_checkpoints_and_components_leave_no_shuffle_files(spark):
    def files() -> int:
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    edges = [(int(a), int(b)) for a, b in np.random.default_rng(3).integers(-200, 200, (180, 2))] + [(999, 999)]
    table, before = spark.createDataFrame(edges, "a long, b long"), files()
    cut(table.groupBy("a").count())
    few = connected_components(table)
    assert files() <= before
    assert sorted(few.collect()) == sorted(connected_components(table, at_once=0).collect())


def test_passages_number_documents_and_chain_in_arrays(spark):
    keys = [(k, th) for k in [None, 5, -3, 900, 17] for th in (8, -8)]
    got = {(r.key, r.th): r.d for r in passages.numbered(spark.createDataFrame(keys, "key long, th long").repartition(7)).collect()}
    assert [got[k] for k in sorted(keys, key=lambda k: (k[0] is None, k[0] or 0, k[1]))] == list(range(10))
    rng = np.random.default_rng(5)
    rows = [np.cumsum(rng.integers(0, 70, (int(rng.integers(0, 9)), 2)), 0).tolist() for _ in range(500)]
    x, y = ([[int(p[i]) for p in r] for r in rows] for i in (0, 1))
    want = [passages.whole(a, b, list(range(len(a)))) for a, b in zip(x, y, strict=True)]
    plain = passages.chained_whole(pa.array(x, pa.list_(pa.int32())), pa.array(y, pa.list_(pa.int32()))).tolist()
    assert plain == want and 0 < sum(want) < 500
