"""Benchmark windows, secrets, languages, toxicity and tokens against plain versions."""

import base64
import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from almagest.llm import decontaminate, language_id, secrets, token_counts, toxicity
from almagest.llm import common
from made_documents import make  # noqa: F401


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_of_slices_match_a_plain_reading():
    texts = ["Ünï Code-Test", "", None, "a", " lead", "trail ", "x" * 40 + "y", "日本 語 naïve_1", "A1b2.C3"]
    column = pa.array(texts * 3)
    for size in (1, 30, 1 << 20):
        got, whole = [], []
        for data, offsets in common.text_slices(column, size):
            found = common.words(data, offsets, common.WORD_BYTES)
            raw = found.data.tobytes()
            for a, b in zip(found.first[:-1], found.first[1:]):
                got.append([raw[found.start[k] : found.end[k]].decode() for k in range(a, b)])
            whole.extend(zip([w for row in got[len(whole) and -len(offsets) + 1 :] for w in row], found.hashes.tolist()))
        assert got == [words_of(t) for t in texts * 3]


def test_hash_follows_content_alone():
    data = np.frombuffer(b"abcdefghijk abcdefghijk abcdefghij", np.uint8)
    h = common.span_hashes(data, np.array([0, 12, 24]), np.array([11, 23, 34]))
    assert h[0] == h[1] != h[2]


def random_words(draw, n, size=400):
    return " ".join(f"v{draw.randrange(size)}" for _ in range(n))


def test_suffix_array_orders_suffixes():
    draw = np.random.default_rng(1)
    for n, symbols, depth in ((1, 3, 4), (50, 2, 64), (300, 3, 40), (500, 40, 12)):
        text = draw.integers(1, symbols + 1, n).astype(np.uint64)
        array = decontaminate.SuffixArray(text, depth)
        shown = [tuple(text[k : k + depth].tolist()) for k in array.order]
        assert shown == sorted(shown) and sorted(array.order.tolist()) == list(range(n))


def plain_hits(docs, bench, window=10):
    out = []
    for i, t in docs:
        w = words_of(t)
        hit, items = set(), set()
        for item, text in bench:
            own = words_of(text)
            size = min(window, len(own))
            grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
            for k in range(len(w) - size + 1):
                if size and tuple(w[k : k + size]) in grams:
                    hit.update(range(k, k + size))
                    items.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_benchmark_windows(spark, make, block):
    draw = random.Random(3)
    bench = [(k, random_words(draw, n)) for k, n in enumerate((30, 10, 9, 3, 1, 60, 25))] + [(7, None), (8, "..."), (5, "repeated id only here"), (None, random_words(draw, 14))]
    twin = bench[0][1]
    docs = [(k, random_words(draw, 200)) for k in range(20)]
    docs += [
        (30, f"intro, {twin.upper()} outro"), (31, twin), (32, " ".join(twin.split()[:9])), (33, " ".join(twin.split()[5:15])), (34, None), (35, ""), (36, bench[3][1]),
        (37, bench[5][1] + " " + bench[5][1]), (38, " ".join(bench[2][1].split()[:8])), (39, bench[10][1]), (40, ("pad " * 30_000) + bench[6][1]), (41, twin), (41, twin),
    ]
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontaminate.matches(make(docs), table, block_bytes=block)
    shown = sorted(
        ((r.doc_id, r.found["words"], sum(s["last"] - s["first"] for s in r.found["spans"]), list(r.found["items"])) for r in got.collect()), key=str
    )
    assert shown == plain_hits(docs, bench)
    longest = {r.doc_id: r.found["longest"] for r in got.collect()}
    assert longest[31] == 30 and longest[37] == 60 and longest[35] == 0
    clean = decontaminate.clean(make(docs), table, block_bytes=block)
    assert clean.columns == make(docs).columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _, n, _ in plain_hits(docs, bench) if not n)


def test_benchmark_of_nothing(spark, make):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.clean(make([(1, "a b"), (2, None)]), none).count() == 2
    assert decontaminate.clean(make([]), none).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = [("assign", ASSIGN, lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def plain_base(text):
    spans = [(m.start(), rank, kind, m.end()) for rank, (kind, rx, fits) in enumerate(KINDS) for m in rx.finditer(text or "") if fits(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))


def noise(seed, n, alphabet):
    draw = random.Random(seed)
    return "".join(draw.choice(alphabet) for _ in range(n))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_secrets(make):
    hexes = noise(1, 40, "0123456789abcdef")
    rows = [
        (1, f"é password = '{hexes}' and TOKEN:short token: {noise(2, 30, LETTERS)}."), (2, "AKIA" + noise(3, 12, LETTERS[:26]) + " AKIAAKIA1 AKIA"), (3, None), (4, ""),
        (5, hexes + hexes[:31] + "g" + hexes[:31] + " " + hexes[:32]), (6, "secret=" * 5 + "abcdefgh api-key=abcdefgh api_key=abcdefgh APIKEY=xyz"),
        (7, ("password=" + "a" * 9 + " ") * 1500), (8, "token=token=token=abcdefghij"), (9, "\U0001f600 passwd: \"ABCDEFGH\""), (10, "ſecret=abcdefghi"),
    ] + [(100 + k, f"key {noise(('n', k).__repr__(), 44, LETTERS)} end") for k in range(30)] + [(200 + k, f"see {'abcd' * 7}{k % 10}1 end") for k in range(30)]
    docs = make(rows)
    got = secrets.scan(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    texts = dict(rows)
    noisy = {}
    for r in got.collect():
        base = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.secrets if s["kind"] != "random")
        assert base == plain_base(texts[r.doc_id])
        assert all((texts[r.doc_id] or "")[s["start"] : s["end"]] == s["match"] for s in r.secrets)
        noisy[r.doc_id] = any(s["kind"] == "random" for s in r.secrets)
    assert sum(noisy[100 + k] for k in range(30)) >= 28
    assert not any(noisy[200 + k] for k in range(30))
    assert secrets.scan(make([])).count() == 0 and secrets.scan(make([(1, None)])).first().secrets == []


def test_random_values_beside_other_signs(make):
    key = lambda k: noise(("value", k).__repr__(), 44, LETTERS)
    forms = ["DB_PASS={}", "see ?a=1&sig={}", "=={} end", "é NAME_OF_IT={}== end", "/srv/my-app/{}", "/a_b/{}/x-y", "a+b-c/{}"]
    rows = [(100 * n + k, form.format(key(100 * n + k))) for n, form in enumerate(forms) for k in range(20)]
    rows += [(5000 + k, "LONG_NAME_1_OF_A_VARIABLE=" + "abcd" * 7 + "1") for k in range(20)]
    texts = dict(rows)
    found = {r.doc_id: [s for s in r.secrets if s["kind"] == "random"] for r in secrets.scan(make(rows)).collect()}
    assert all(texts[i][s["start"] : s["end"]] == s["match"] for i, own in found.items() for s in own)
    for n in range(len(forms)):
        hits = [any(s["match"].rstrip("=") == key(100 * n + k) for s in found[100 * n + k]) for k in range(20)]
        assert sum(hits) >= 17, forms[n]
    assert {s["match"][44:] for k in range(20) for s in found[300 + k]} == {"=="}
    assert not any("abcd" * 7 in s["match"] for k in range(20) for s in found[5000 + k])


def test_battery_against_plain_statistics(spark):
    tokens = [noise(k, 25 + k, LETTERS) for k in range(12)] + ["aaaa1111" * 6, "abcdefghij0123456789" * 2]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(secrets.F.col("t")).alias("b")).collect()
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    for r in rows:
        index = next(k for k, (_, a) in enumerate(secrets.ENCODINGS) if set(r.t) <= set(a))
        alphabet = secrets.ENCODINGS[index][1]
        n, k = len(r.t), len(alphabet)
        x = [alphabet.index(c) for c in r.t]
        mid = (k - 1) / 2
        chi = k / n * sum(r.t.count(c) ** 2 for c in set(r.t)) - n
        v = 2 / (9 * (k - 1))
        uneven = tail(((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - v)) / math.sqrt(v))
        runs = 2 * tail(abs(sum((a > mid) != (b > mid) for a, b in zip(x, x[1:])) - (n - 1) / 2) / math.sqrt((n - 1) / 4))
        serial = 2 * tail(abs(sum((a - mid) * (b - mid) for a, b in zip(x, x[1:])) / ((k * k - 1) / 12) / math.sqrt(n - 1)))
        assert (r.b["encoding"], r.b["octave"]) == (index, int(math.log2(n)))
        assert r.b["p"] == pytest.approx(min(1, 3 * min(uneven, runs, serial)), abs=1e-5)


def plain_profile(texts):
    counts = {}
    for text in texts:
        s = "".join(c.lower() if c.isalpha() else " " for c in text)
        s = f" {s} "
        for n in (1, 2, 3):
            for k in range(len(s) - n + 1):
                gram = s[k : k + n]
                if gram.strip() and not (n == 3 and gram[1] == " "):
                    counts[gram] = counts.get(gram, 0) + 1
    packed = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    return {packed(g): k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], packed(g)))[: language_id.PROFILE])}


ENGLISH = ["the quick brown fox jumps over the lazy dog and then the other one", "this is what they thought of that thing with the weather"]
GERMAN = ["der schnelle braune fuchs springt über den faulen hund und dann", "das ist nicht was ich gestern über das wetter gedacht hatte"]


def test_rank_profiles(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([*((t, "en") for t in ENGLISH), *((t, "de") for t in GERMAN), (None, "en"), ("xyz", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.profiles(docs)
    shown = {lang: {r.gram: r["rank"] for r in learned.collect() if r.lang == lang} for lang in ("de", "en")}
    want = {"en": plain_profile(ENGLISH), "de": plain_profile(GERMAN)}
    assert shown == want
    asked = ["The thing", "Über das Wetter", "", None, "123 !?", "é", "THE WEATHER\n" * 20_000, "I"]
    got = [(r.language["lang"], r.language["score"]) for r in language_id.identify(spark.createDataFrame([(k, t, "x") for k, t in enumerate(asked)], "n long, text string, LANGUAGE string"), learned).sort("n").collect()]
    for text, (lang, score) in zip(asked, got):
        own = plain_profile([text or ""])
        if not own:
            assert (lang, score) == ("und", 0.0)
            continue
        far = {x: sum(abs(rank - want[x][g]) if g in want[x] else language_id.PROFILE for g, rank in own.items()) for x in want}
        best = min(sorted(far), key=far.get)
        assert lang == best and score == pytest.approx(1 - far[best] / (len(own) * language_id.PROFILE))
    nothing = language_id.profiles(docs.where("lang = 'none'"))
    assert {r.language["lang"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_meets_what_edit_distance_says():
    draw = random.Random(9)
    terms = ["idiot", "trash", "worthless", "disgusting", "scum", "abcdeabcde", "übelkeit"]
    pool = {"".join(draw.choice("abcdeo") for _ in range(draw.randrange(1, 12))) for _ in range(400)}
    for term in terms:
        for _ in range(40):
            w = list(term)
            for _ in range(draw.randrange(4)):
                k = draw.randrange(len(w) + 1)
                w[k : k + draw.randrange(2)] = draw.choice(["", "x", "e"])
            pool.add("".join(w))
    pool.discard("")
    got = toxicity.Lexicon(terms).meet(sorted(pool))
    for word in pool:
        near = [(d, k) for k, t in enumerate(terms) if (d := edits(word, t)) <= toxicity.edits_for(t)]
        assert got.get(word) == min(near, default=None)
    stems = toxicity.Lexicon(["lowe*", "scum"]).meet(["lowe", "lower", "lowx", "scum", "scums"])
    assert stems == {"lowe": (0, 0), "lower": (0, 0), "scum": (0, 1)}


def test_words_under_a_stem_keep_their_edits():
    terms = toxicity._settled({"idiot": 100, "idiots": 60, "idio*": 160, "idiot*": 60})
    assert {"idiot", "idiots", "idio*"} <= set(terms)
    got = toxicity.Lexicon(terms).meet(["idi0t", "idxiot", "idiot", "idiotic", "plain"])
    assert {w: (n, terms[t]) for w, (n, t) in got.items()} == {"idi0t": (1, "idiot"), "idxiot": (1, "idiot"), "idiot": (0, "idiot"), "idiotic": (0, "idio*")}
    reader = toxicity.Reader(terms, [])
    weigh = lambda t: reader.read(*next(common.text_slices(pa.array([t]))))[0, 2]
    assert weigh("he is an idi0t indeed today") == pytest.approx(0.7) and weigh("he is an idiot indeed today") == 1.0


def toxic_corpus(n=400):
    rows, labels = [], []
    for k in range(n):
        draw = random.Random(k)
        body = random_words(draw, 60).split()
        bad = k % 4 == 0
        if bad:
            for term in ("worthless", "pathetic", "idiot"):
                body.insert(draw.randrange(len(body)), term)
        rows.append((k, " ".join(body)))
        if k % 5:
            labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_learns_terms_and_weighs_context(spark, make):
    rows, labels = toxic_corpus()
    known = spark.createDataFrame(labels + [(None, 1), (10**6, 1), (1, None)], "doc_id long, toxic int")
    docs = make(rows, extra=False)
    model = toxicity.learn(docs, known)
    assert set(model[0]) >= {"worthless", "pathetic", "idiot"}
    asked = make([(k, t) for k, t in rows if k % 5 == 0] + [(1000, None), (1001, ""), (1002, "you are worthles and pathetik, idiot"), (1003, "plain " * 60_000)])
    got = {r.doc_id: r.toxicity for r in toxicity.score(asked, model).collect()}
    held = [(got[k] >= toxicity.CUTOFF) == (k % 4 == 0) for k, _ in rows if k % 5 == 0]
    assert sum(held) / len(held) > 0.97 and got[1002] >= toxicity.CUTOFF
    assert got[1000] == got[1001] < toxicity.CUTOFF and got[1003] < toxicity.CUTOFF
    assert sorted(asked.columns) == sorted(toxicity.score(asked, model).columns)


def test_quotation_weighs_less():
    reader = toxicity.Reader(["idiot"], [])
    weigh = lambda t: reader.read(*next(common.text_slices(pa.array([t]))))[0, 2]
    assert weigh("he is an idiot indeed today") == 1.0
    assert weigh("you are an idiot indeed today") == pytest.approx(1.2)
    assert weigh("she wrote the word idiot on it") == pytest.approx(0.4)
    assert weigh("there it read “an idiot” in red") == pytest.approx(0.4)


def test_toxicity_without_labels(spark, make):
    docs = make([(1, "a b c"), (2, None)], extra=False)
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model[0] == [] and {0 <= r.toxicity <= 1 for r in toxicity.score(docs, model).collect()} == {True}


VOCABULARY = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary")
@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_of_sections(make, rule):
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(str(VOCABULARY.with_suffix(".json")))
    plain.encode_special_tokens = True
    rows = [(1, "Hello world.\n\n\nSecond  line, naïve 日本\n"), (2, None), (3, ""), (4, "\n"), (5, "a \n b"), (6, "<|endoftext|>\n\U0001f600 x"), (7, "word " * 20_000), (8, "one"), (8, "one"), (9, "a\r\n\r\nb   ")]
    got = {}
    for r in token_counts.sections(make(rows), str(VOCABULARY), rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.doc_tokens))
    for i, text in dict(rows).items():
        text = text or ""
        own = sorted(set(got[i]))
        tokens = len(plain.encode(text, add_special_tokens=False).ids)
        assert {x[4] for x in own} == {tokens} and sum(x[3] for x in own) == pytest.approx(tokens)
        assert "".join(text[a:b] for _, a, b, _, _ in own) == text
        assert [text[a:b] for _, a, b, _, _ in own] == (re.findall(r"[^\n]*\n|[^\n]+", text) or [""])
    assert len(got[8]) == 2


def test_allocation_rules():
    edges, sections = np.array([0, 2, 7, 9]), np.array([0, 4, 6])
    assert token_counts.allocated(edges, sections, 9, "first")[0].tolist() == [2, 0, 1]
    assert token_counts.allocated(edges, sections, 9, "most")[0].tolist() == [2, 0, 1]
    assert token_counts.allocated(edges, sections, 9, "share")[0].tolist() == pytest.approx([1.4, 0.4, 1.2])


def test_digest_of_items():
    assert decontaminate.items_digest(["10", "9"]) == hashlib.sha256(b"10,9").hexdigest() and base64.b64decode("YQ==") == b"a"
