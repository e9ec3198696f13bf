"""Source divergence, language profiles and part codes against plain Python over small, awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from millrace.llm import divergence, langid, partcodes

DOCS = "doc_id long, text string, lang string, source string, kept string, term string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r, None, "x") for i, r in enumerate(rows)], DOCS)


# ---- divergence


def plain_audit(rows):
    words = [(lang or "", source or "", re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in words:
        held[lang].update(set(w))
        counts[lang, source].update(w)
    out = set()
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= 3]
        sources = [s for la, s in counts if la == lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pair, 1)}
            out |= {(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(term[: divergence.TOP], 1)}
    return out


def corpus(n, sources, seed):
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("a", "b", "Ç", "dz", "É") for b in ("a", "é", "word", "x", "漢", "Y")]
    return [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) + rng.choice(["", "\n", "1,2", "'s"]), rng.choice(["en", "fr", None]), rng.choice(["hot", f"s{rng.randrange(sources)}", None])) for _ in range(n)]


ODD = [(None, None, None), ("", "", ""), ("...", "de", "a"), ("only one", "it", "alone"), ("A a a A", "de", "b"), ("a", "de", "b"), ("a", "de", "b"), ("a", "de", "b")]


@pytest.mark.parametrize("chunk,block,top", [(64, 1024, 200), (3, 4, 5), (1, 1, 2)])
def test_audit_is_plain(spark, monkeypatch, chunk, block, top):
    monkeypatch.setattr(divergence, "CHUNK_GROUPS", chunk)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "TOP", top)
    rows = corpus(150, 5, 1) + ODD
    got = [tuple(r) for r in divergence.audit(docs_of(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_audit(rows)


def test_audit_of_nothing(spark):
    assert divergence.audit(docs_of(spark, [])).collect() == []
    assert {tuple(r) for r in divergence.audit(docs_of(spark, [("x", "en", "a"), ("y", "en", "b")])).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_pieces_cut_between_terms(monkeypatch):
    text = " ".join(["ab", "c" * 50, "", "é1d", "E"] * 9).encode()
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [t for p in divergence._pieces(text) for t in p] == text.translate(divergence._FOLD).split()
    assert [t for p in divergence._pieces(b"x" * 100) for t in p] == [b"x" * 100]


def test_shares_of_large_counts_are_exact():
    n, total = [0, 5, 10**12, 3 * 10**14], [7, 10**9, 10**13, 4 * 10**14]
    assert divergence.shares(np.array(n), np.array(total), 12345).tolist() == [1 + 10**9 * (a + 1) // (b + 12345) for a, b in zip(n, total)]


# ---- languages


def plain_profile(texts):
    counts = Counter()
    for text in texts:
        for w in regex.findall(r"[\p{L}\p{M}]+", (text or "").lower()):
            w = f" {w} "
            counts.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    return {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE])}


def plain_languages(rows):
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    langs = {la for i, (_, la, _) in enumerate(rows) if la is not None and not out(i)}
    profiles = {la: plain_profile(t for i, (t, x, _) in enumerate(rows) if x == la and not out(i)) for la in langs}
    profiles = {la: p for la, p in profiles.items() if p}
    found = []
    for i, (text, _, _) in enumerate(rows):
        own = plain_profile([text])
        d = {la: sum(abs(p[g] - k) if g in p else langid.PROFILE for g, k in own.items()) for la, p in profiles.items()}
        if own and d:
            la = min(d, key=lambda x: (d[x], x.encode()))
            found.append((i, out(i), la, round(1 - d[la] / (langid.PROFILE * len(own)), 9)))
        else:
            found.append((i, out(i), "und", 0.0))
    return found


def spoken(n, seed):
    rng = random.Random(seed)
    syllables = {"en": ["the", "ing", "and", "tion"], "de": ["sch", "ung", "ein", "ß"], "Fr": ["é", "que", "eau", "ment"], "zz": ["漢", "字"]}
    rows = []
    for _ in range(n):
        la = rng.choice(list(syllables))
        words = ["".join(rng.choices(syllables[la], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 25))]
        rows.append((rng.choice([" ", "\n", ", 12 "]).join(words).title(), la if rng.random() < 0.9 else None, "s"))
    return rows


@pytest.mark.parametrize("lots", [2000, 1, 3])
def test_languages_are_plain(spark, monkeypatch, lots):
    monkeypatch.setattr(langid, "LANGS", lots)
    rows = spoken(80, 3) + [(None, "en", None), ("", "en", None), ("12 — …", "de", None), ("²½", "en", None), ("a", None, None), ("É" * 3000, "Fr", None)] + [("same text", "en", "s")] * 3
    got = sorted((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in langid.identify(docs_of(spark, rows)).collect())
    assert got == plain_languages(rows)
    assert all(0 <= r[3] <= 1 for r in got)


@pytest.mark.parametrize("piece", [1, 2, 5, 64])
def test_pieces_of_a_text_count_as_the_whole(monkeypatch, piece):
    text = "Ein  Satz, é12 (a) —\nund noch einer " * 5
    codes, counts, letters = langid.counted(text)
    assert letters and len(codes) > 20
    monkeypatch.setattr(langid, "PIECE", piece)
    again = langid.counted(text)
    assert again[0].tolist() == codes.tolist() and again[1].tolist() == counts.tolist() and again[2]
    assert [len(x) for x in langid.counted("")[:2]] == [0, 0] and not langid.counted(" 1")[2]


def test_languages_without_training_rows(spark):
    assert langid.identify(docs_of(spark, [])).collect() == []
    got = langid.identify(docs_of(spark, [("hello", None, None), (None, None, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


def test_lang_and_source_do_not_sway_a_prediction(spark):
    rows = spoken(60, 4)
    out = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(rows))]
    turned = [(t, "de", "other") if o else (t, la, s) for (t, la, s), o in zip(rows, out)]
    one, two = (sorted(tuple(r) for r in langid.identify(docs_of(spark, x)).collect()) for x in (rows, turned))
    assert one == two


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 100").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)


# ---- part codes


def plain_codes(rows, length):
    def bad(x):
        return x is None or math.isnan(x) or math.isinf(x)

    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and not any(map(bad, v)) and len(v) == length]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = length // 16
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, _, v in kept[:64]] for p in range(16)]
    near = lambda b, v: min((sum((x - y) ** 2 for x, y in zip(v, e)), k) for k, e in enumerate(b))
    for _ in range(2):
        for p in range(16):
            dealt = defaultdict(list)
            for _, _, v in kept:
                dealt[near(books[p], part(v, p))[1]].append(part(v, p))
            books[p] = [[sum(x) // len(dealt[k]) for x in zip(*dealt[k])] if k in dealt else e for k, e in enumerate(books[p])]
    coded = [(i, label, [near(books[p], part(v, p)) for p in range(16)]) for i, label, v in kept]
    sums = Counter()
    for _, label, found in coded:
        sums[label] += sum(d for d, _ in found)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), sums[label], sha) for i, label, found in coded]


VECTORS = "vec_id long, embedding array<double>, label int, code string, v int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS)


def by_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("n,length,spread", [(300, 32, 1.0), (150, 16, 0.004), (20, 48, 50.0)])
def test_codes_are_plain(spark, n, length, spread):
    rng = random.Random(n)
    rows = [(rng.randrange(n), [rng.gauss(0, spread) for _ in range(length)], rng.choice([1, 1, 1, 2, None])) for _ in range(n)]
    rows += rows[:5]
    rows += [(1000, None, 1), (-1, [None] * length, 1), (-2, [float("nan")] * length, 1), (-3, [float("inf")] + [0.0] * (length - 1), 2), (2000, [1.0] * 5, 1), (None, [0.5] * length, 1)]
    got = partcodes.compress(vectors_of(spark, rows)).collect()
    assert by_text(map(tuple, got)) == by_text(plain_codes(rows, length))


def test_codes_of_nothing_and_of_huge_components(spark):
    assert partcodes.compress(vectors_of(spark, [])).collect() == []
    assert partcodes.compress(vectors_of(spark, [(1, [1.0] * 17, 1), (2, [], 1), (3, None, 1)])).collect() == []
    got = partcodes.compress(vectors_of(spark, [(1, [1e300] * 64, 1), (2, [-1e300] * 64, 1), (3, [0.0] * 64, 1)])).collect()
    assert sorted(r["error"] for r in got) == [0, 0, 0]


@pytest.mark.parametrize("width,spread,size", [(4, 30, 64), (4, 2, 64), (1, 3, 64), (8, 100, 37), (2, 1, 1)])
def test_search_equals_all_distances(width, spread, size):
    rng = np.random.default_rng(size + spread)
    book, points = rng.integers(-spread, spread + 1, (size, width)), rng.integers(-2 * spread, 2 * spread + 1, (3000, width))
    book[size // 2 :] = book[: size - size // 2]  # equal entries
    found = partcodes.Search(book, partcodes.grow(book, np.arange(size)), points)
    squared = ((points[:, None] - book[None]) ** 2).sum(-1)
    assert (found.best == squared.min(1)).all()
    assert (found.index == squared.argmin(1)).all()
    if spread == 30:
        assert found.seen < 0.8 * squared.size


def test_roots_are_whole():
    n = np.array([0, 1, 2, 3, 4, 2**52 - 1, (2**31 - 1) ** 2 - 1, (2**31 - 1) ** 2, (2**31 - 1) ** 2 + 1, 2**62 - 1])
    assert partcodes.root_down(n).tolist() == [math.isqrt(int(x)) for x in n]
    assert partcodes.root_up(n).tolist() == [math.isqrt(int(x)) + (math.isqrt(int(x)) ** 2 < int(x)) for x in n]
