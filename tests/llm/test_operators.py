"""Every operator against brute force, on texts chosen to be awkward."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.llm import chat, classifier, encoding, langid, media, mixing, packing, pii, quality, similar, simhash, tokens
from tidegauge.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} the of" for i in range(30_000))
AWKWARD = [
    None, "", " ", "\n\n", "a", "A  b\t c\r\n", "The quick brown fox. The quick brown fox. The quick", "x" * 70_000, LONG, "é ü ñ " * 40, "日本語 テキスト。", "<|endoftext|> </s> [INST] hi [/INST]",
    "mail a.b+c@d-e.co.uk, b@c.d@e.f; 1.2.3.4.5.6.7.8 256.1.1.1 0000.0.0.255 4111 1111 1111 1111 41111111111111112 +1 (555) 555-0100. +12 3", "#$% ^& | < > " * 30, "line one two\nline one two\nother line\n" * 3, "  x \xa0 y", "same text", "same text", "SAME TEXT",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    out = [(i, t, ["en", None, "fr"][i % 3], [None, "b", "a", "hot", "hot"][i % 5], len(t or "")) for i, t in enumerate(AWKWARD)]
    return out + [(None, "no id", "en", "a", 5), (3, "repeated id", "en", "b", 11), (3, "repeated id", "en", "b", 11)]


CLASH = ["lang_pred", "score", "size", "key", "h", "kept", "spans", "n_words", "ids", "start", "component", "fp", "id", "copies", "payload", "fingerprint", "frames", "held", "terms"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter(F.lit(False))


def say(texts):
    return np.array(texts, "<u4").tobytes()


def test_batches_are_bounded_in_bytes(spark):
    """Texts of a megabyte: no batch holds a thousand of them."""
    import pyarrow as pa

    from tidegauge.llm.common import through_arrow

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    df = spark.range(0, 150, 1, 1).select("id", F.repeat(F.lit("abcdefgh"), 1 << 17).alias("text"))
    got = through_arrow(df, sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 150 and max(r.bytes for r in got) <= (64 << 20) + (2 << 20)


# --- token ids ----------------------------------------------------------------


@pytest.fixture(scope="module", params=["byte", "word"])
def enc(request):
    return encoding.Encoder(tokenizer({"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}[request.param]), request.param, 2)


def whole(enc, text):
    return enc.tok.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_on_awkward_texts(enc):
    import pyarrow as pa

    for _ in range(2):  # the second time from what is remembered
        for a, b, ids, at in enc.encode(pa.array(AWKWARD)):
            for i in range(a, b):
                assert ids[at[i - a] : at[i - a + 1]].tolist() == whole(enc, AWKWARD[i])


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet="abÉs1.,'! \n\t\r\x0b　\xa0<|>eno\x00\x1c", max_size=40))
def test_encoder_equals_the_library(enc, text):
    assert np.frombuffer(enc.text(text), np.uint32).tolist() == whole(enc, text)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="abÉ1.,' \n\t\u2003\xa0<>s\x00", max_size=30)), min_size=1, max_size=6))
def test_slices_equal_the_library(enc, texts):
    import pyarrow as pa

    got = [ids[x:y].tolist() for _, _, ids, at in enc.encode(pa.array(texts, pa.string())) for x, y in zip(at[:-1], at[1:], strict=True)]
    assert got == [whole(enc, t) for t in texts]


def test_encoder_forgets(enc, monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 5)
    import pyarrow as pa

    texts = [" ".join(random.Random(i).choices(["one", "two,", "three.", "Four", "5", "six\nseven"], k=30)) for i in range(50)]
    monkeypatch.setattr(encoding, "SLICE", 100)
    for a, b, ids, at in enc.encode(pa.array(texts)):
        for i in range(a, b):
            assert ids[at[i - a] : at[i - a + 1]].tolist() == whole(enc, texts[i])


@pytest.mark.parametrize("kind, name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_a_slice_takes_each_new_word_to_the_library_once(kind, name):
    import pyarrow as pa

    enc = encoding.Encoder(tokenizer(name), kind, 2)
    seen, units = Counter(), enc.units
    enc.units = lambda x: seen.update([x]) or units(x)
    texts = ["so quixotry and quixotry", None, "is quixotry", f"a {'long' * 30} {'long' * 30}", "", "an  quixotic"]
    for a, b, ids, at in enc.encode(pa.array(texts)):
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [whole(enc, t) for t in texts[a:b]]
    assert [n for x, n in seen.items() if "quixotry" in x or "long" in x] == [1, 1]


def test_token_files(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    tokens.write(docs, path, tokenizer("byte_bpe_50k.json"))
    enc = encoding.encoder(tokenizer("byte_bpe_50k.json"), "byte", 2)
    got = sorted(tokens.checksums(tokens.read(spark, path)).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows()), key=lambda x: (x is not None, x))
    want = Counter((r[0], len(x := whole(enc, r[1])), zlib.crc32(say(x))) for r in rows())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_token_files_have_no_level_for_null_ids(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    tokens.write(docs, str(tmp_path / "ids"), tokenizer("byte_bpe_50k.json"))
    for f in (tmp_path / "ids").glob("*.parquet"):
        assert not pq.read_schema(f).field("ids").type.value_field.nullable


def test_token_files_of_nothing(spark, nothing, tmp_path):
    tokens.write(nothing, str(tmp_path / "ids"), tokenizer("byte_bpe_50k.json"))
    assert tokens.checksums(tokens.read(spark, str(tmp_path / "ids"))).count() == 0


# --- language -----------------------------------------------------------------


def brute_profile(texts, size):
    counts = Counter()
    for t in texts:
        folded = " " + re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in t.lower())).strip() + " "
        for n in (1, 2, 3):
            for i in range(len(folded) - n + 1):
                g = folded[i : i + n]
                if g != " " and (n < 3 or g[1] != " "):
                    counts[g] += 1
    return [g for g, _ in sorted(counts.items(), key=lambda kv: (-kv[1], [0] * (3 - len(kv[0])) + [ord(c) for c in kv[0]]))][:size]


def unpack(gram):
    out = ""
    while gram:
        out = chr(gram & 0x1FFFFF) + out
        gram >>= 21
    return out


@pytest.mark.parametrize("text", [t for t in AWKWARD if t and any(c.isalpha() for c in t)])
def test_profiles(text):
    assert [unpack(int(g)) for g in langid.ranked(*langid.ngrams(text))] == brute_profile([text], langid.PROFILE)


def test_pieces_count_like_the_whole(monkeypatch):
    want = langid.ngrams(LONG[:5000])
    monkeypatch.setattr(langid, "PIECE", 64)
    got = langid.ngrams(LONG[:5000])
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_identify(spark, docs, nothing):
    train = spark.createDataFrame([("en", "the of and to in that is was for it with as"), ("fr", "le la les des est une dans que pour qui ne"), (None, "x"), ("de", None)], "lang string, text string")
    profiles = langid.learn(train)
    assert set(profiles) == {"en", "fr"} and [unpack(int(g)) for g in profiles["fr"]] == brute_profile(["le la les des est une dans que pour qui ne"], langid.PROFILE)
    p = langid.Predictor(profiles)
    assert p.predict("that was the house")[0] == "en" and p.predict("les maisons dans la rue")[0] == "fr"
    own = brute_profile(["that was the house"], 300)
    for i, k in enumerate(p.names):
        ranks = {unpack(int(g)): r for r, g in enumerate(profiles[k])}
        assert p.distances(langid.ranked(*langid.ngrams("that was the house")))[i] == sum(min(300, abs(ranks[g] - r)) if g in ranks else 300 for r, g in enumerate(own))
    got = {(r.text): (r.lang_pred, r.score) for r in langid.identify(docs, profiles).collect()}
    assert got[None] == ("und", 0.0) and got["\n\n"] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(nothing, profiles).count() == 0
    assert langid.learn(nothing) == {} and langid.Predictor({}).predict("text") == ("und", 0.0)


def test_a_rare_language_keeps_all_its_rows(spark):
    made = [("en", "the of and to in that is was for it")] * 4000 + [("fr", "le la les des est une dans")] * 2 + [("el", "και το να")]
    got = langid.learn(spark.createDataFrame(made, "lang string, text string").repartition(3), rows=40)
    assert set(got) == {"en", "fr", "el"}
    for lang, text in made[-2:]:
        assert [unpack(int(g)) for g in got[lang]] == brute_profile([text], langid.PROFILE)


# --- SimHash ------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", AWKWARD)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def planted(n=250, seed=4):
    rng = random.Random(seed)
    fps = [0, 7, 2**63]
    while len(fps) < n:
        x = rng.choice(fps) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    return fps


def test_trie_walk_finds_every_pair():
    bits = np.unique(np.array(planted(400), np.uint64))
    root = simhash.trie_links(np.zeros(len(bits), np.int64), bits)
    want = brute_components(dict(enumerate(int(b) for b in bits)))
    assert root.tolist() == [want[i] for i in range(len(bits))]


def test_trie_walk_in_little_memory():
    """Half a million fingerprints, half of them near copies."""
    import tracemalloc

    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 63, 250_000, np.uint64)
    bits = np.unique(np.concatenate((one, one ^ (np.uint64(1) << rng.integers(0, 64, len(one)).astype(np.uint64)))))
    keys = (bits >> np.uint64(58)).astype(np.int64)
    tracemalloc.start()
    root = simhash.trie_links(keys, bits)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20 and (root != np.arange(len(root))).sum() >= 225_000


def test_buckets_of_one_hot_key_keep_every_pair(spark):
    """All nodes share 28 bits, so two levels are too full."""
    rng = random.Random(6)
    fps = sorted({(0xABCDE << 44) | (0x5 << 20) | rng.getrandbits(9) | rng.getrandbits(9) << 30 for _ in range(300)})
    got = defaultdict(set)
    for r in simhash.buckets(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), 20).collect():
        got[r.key].add(r.fp & (2**64 - 1))
    together = {(a, b) for v in got.values() for a in v for b in v if a < b}
    assert {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3} <= together
    assert len(got) > 100


@pytest.mark.parametrize("hot", [2, 50_000])
def test_links_and_components(spark, monkeypatch, hot):
    fps = planted()
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select(F.col("doc_id").alias("id"), F.col("text").cast("long").alias("fp")))
    df = spark.createDataFrame([(i * 3, str(simhash._signed(x))) for i, x in enumerate(fps)], "doc_id long, text string")
    got = {r.id: r.component for r in simhash.near_duplicates(df, hot=hot).collect()}
    assert got == brute_components({i * 3: x for i, x in enumerate(fps)})


def test_near_duplicates_of_awkward_texts(spark, docs, nothing):
    got = [(r.id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs).collect()]
    assert Counter(g[:2] for g in got) == Counter((r[0], brute_fingerprint(r[1])) for r in rows())
    by = {(i, f): c for i, f, c in got}
    same = brute_fingerprint("same text")
    assert by[16, same] == by[17, same] == by[18, same] == 16 and by[0, 0] == by[1, 0] == by[2, 0] == 0 and by[3, brute_fingerprint("repeated id")] == 3
    assert by[None, brute_fingerprint("no id")] is None
    kept = [r.doc_id for r in simhash.representatives(docs).collect()]
    assert len(kept) == len(set(kept)) and {16, 0, 3, None} <= set(kept) and not {1, 2, 17, 18} & set(kept)
    assert simhash.representatives(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0


def test_one_row_of_each_group_however_ids_repeat(spark):
    """Groups of texts are apart although they share an id or have none."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    made = [(None, text("a")), (None, text("b")), (None, text("b")), (5, text("c")), (5, text("d")), (7, text("a")), (8, text("d")), (5, text("c"))]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    kept = Counter(map(tuple, simhash.representatives(df).collect()))
    assert kept == Counter([(7, text("a")), (None, text("b")), (5, text("c")), (5, text("d"))])
    got = Counter((r.id, r.component) for r in simhash.near_duplicates(df).collect())
    assert got == Counter({(None, 7): 1, (7, 7): 1, (None, None): 2, (5, 5): 3, (8, 5): 1})


@pytest.mark.parametrize("block", [2048, 7])
def test_every_near_copy_goes(spark, monkeypatch, block):
    """Against all pairs of 5-word shingle sets; SimHash's three bits missed most of these copies."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [rng.choices(words, k=rng.randint(8, 150)) for _ in range(60)]
    for i in range(240):  # words replaced, from few to more than 0.8 bears; one base has a third of the copies
        t = list(texts[0 if i % 3 == 0 else i % 60])
        for at in rng.sample(range(len(t)), rng.randint(0, max(1, len(t) // 30))):
            t[at] = rng.choice(words)
        texts.append(t)
    sets = {i: {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for i, t in enumerate(texts)}
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    far = [(a, b) for a, b in pairs if (brute_fingerprint(" ".join(texts[a])) ^ brute_fingerprint(" ".join(texts[b]))).bit_count() > 3]
    assert len(far) > 50
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.representatives(df).collect()} == {find(i) for i in sets}


def brute_prints(s):
    """Votes one by one, each bit by its weighted majority."""
    mixed = lambda x: int(simhash._mixed(np.array([x], np.uint64))[0])
    said = [[(x, 1) for x in s]]
    for a, b in zip(simhash._ODD[1, :, 0].tolist(), simhash._ODD[0, :, 0].tolist(), strict=True):
        votes = sorted(((x ^ i) * j) % 2**64 for x in s for i, j in zip(a, b, strict=True))
        said.append([(mixed(v), 0.6**k) for k, v in enumerate(votes[:32])])
    return [sum(1 << b for b in range(64) if 2 * sum(w for x, w in v if x >> b & 1) > sum(w for _, w in v)) for v in said]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 300, 5000])
def test_prints(n):
    rng = random.Random(n)
    s = [rng.getrandbits(64) for _ in range(n)]
    assert simhash.prints(np.array(s, np.uint64)).tolist() == brute_prints(s)


@pytest.mark.parametrize("n", [5, 10, 40])
def test_prints_of_similar_sets_are_near(n):
    """At a similarity of just 0.8, two of five weighted prints are within three bits, of the plain ones hardly any."""
    rng = np.random.default_rng(n)
    near = []
    for _ in range(400):
        s = rng.integers(0, 1 << 63, n, np.uint64)
        near.append(np.bitwise_count(simhash.prints(s) ^ simhash.prints(s[: n * 4 // 5])) <= simhash.BUDGET)
    near = np.array(near)
    assert near.any(1).all() and near[:, 1:].mean() > 0.36 and near[:, 0].mean() < 0.1


@pytest.mark.parametrize("hot", [3, 50_000])
def test_candidates_are_what_the_trie_joins(spark, hot):
    """A key for each print and all that three bits link to it, each print by itself."""
    made = [planted(60, seed) for seed in (1, 2, 3)]
    made[1][:30] = made[0][:30]  # equal prints of different tables don't meet
    one = spark.createDataFrame([(i, 9, [simhash._signed(x) for x in p]) for i, p in enumerate(zip(*made, strict=True))], "fp long, n long, prints array<long>")
    got = defaultdict(set)
    for r in simhash.candidates(one, hot).collect():
        got[r.key].add(r.fp)
    want = defaultdict(set)
    for k, fps in enumerate(made):
        for i, c in brute_components(dict(enumerate(fps))).items():
            want[k, c].add(i)
    assert Counter(map(frozenset, got.values())) == Counter(map(frozenset, want.values()))


def test_representatives_are_of_the_trie(spark, monkeypatch):
    """The stage has its candidates from the trie: without them, only equal texts go."""
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join([*words, f"x{i % 3}"])) for i in range(6)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.representatives(df).collect()] == [0]
    apart = lambda one, hot: one.select("fp", "n", F.col("fp").alias("key"))
    monkeypatch.setattr(simhash, "candidates", apart)
    assert sorted(r.doc_id for r in simhash.representatives(df).collect()) == [0, 1, 2]


# --- quality rules --------------------------------------------------------------


def brute_measures(t):
    t = t or ""
    w = WORD.findall(t)
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_measures_and_cascade(docs, nothing):
    d = docs
    m = quality.measures(d)
    got = Counter((r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in m.collect())
    assert got == Counter((r[1], *brute_measures(r[1])) for r in rows())
    rules = quality.default_rules()
    want = None
    for sample in (m, m.limit(2), m.limit(0)):  # the order never changes the verdict
        kept = Counter((r.doc_id, r.kept) for r in quality.cascade(m, rules, sample).collect())
        want = want or kept
        assert kept == want
    reject = m.select(*[F.coalesce(r.reject, F.lit(False)).alias(r.name) for r in rules], "doc_id")
    assert Counter((r.doc_id, not any(r[x.name] for x in rules)) for r in reject.collect()) == want
    assert quality.cascade(quality.measures(nothing), rules, m.limit(0)).count() == 0


def test_order_by_rejection_per_cost(spark):
    df = spark.range(100).toDF("x")
    r = [quality.Rule("rare", F.col("x") < 1, F.lit(1.0)), quality.Rule("dear", F.col("x") < 50, F.lit(1000.0)), quality.Rule("good", F.col("x") < 50, F.lit(1.0))]
    assert [x.name for x in quality.ordered(df, r)] == ["good", "rare", "dear"]


# --- personal data ------------------------------------------------------------------


def luhn(x):
    d = [int(c) for c in re.sub(r"\D", "", x)][::-1]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d)) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(re.sub(r"\D", "", x)) <= 19 and luhn(x)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(re.sub(r"\D", "", x)) <= 15),
]


def brute_spans(t):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, t or "") if ok(m[0])]


def base_spans(df):
    names = [b[0] for b in BASE]
    return [(r.text, [(s.kind, s.start, s.end) for s in r.spans if s.kind in names]) for r in pii.find(df).select("text", "spans").collect()]


def test_base_spans(spark, docs, nothing):
    rng = random.Random(8)
    made = ["".join(rng.choice(["1", "12", ".", "@", "a", "-", " ", "+", "(", ")", "é", "255", "4111111111111111", "a@b.c", "+1 555", "_", "%"]) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in made], "text string").unionByName(docs.select("text"))
    for text, spans in base_spans(df):
        assert spans == brute_spans(text), text
    assert pii.find(nothing).count() == 0 and pii.redact(nothing).columns == nothing.columns


def test_many_spans_have_right_offsets(spark):
    text = " ".join(f"é{i}@x.io" for i in range(700))
    ((_, spans),) = base_spans(spark.createDataFrame([(text,)], "text string"))
    assert spans == brute_spans(text) and len(spans) == 700


def test_long_runs_stay_linear(spark):
    import time

    texts = ["a" * 200_000, "1" * 200_000, "1." * 100_000, "a.a" * 60_000 + "@", "1 " * 100_000, "+1" + "(" * 100_000, "a@" + "b." * 80_000]
    begun = time.time()
    base_spans(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert time.time() - begun < 60


def test_validators_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432 there", "GB83WEST12345698765432", "my ssn: 123-45-6789", "123-45-6789", "ssn 000-12-3456", "credit card 378282246310005 amex", "378282246310005"]
    got = [[(s.kind, round(s.score, 3)) for s in r.spans] for r in pii.find(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]
    assert got == [[("iban", 1.0)], [("iban", 0.6)], [], [("ssn", 0.6)], [], [], [("shortcard", 0.6)], []]


def test_redaction(spark, docs):
    for r in pii.redact(docs.select("doc_id", "text")).collect():
        assert (r.text is None) or not [s for s in brute_spans(r.text)], r.text
    df = spark.createDataFrame([(t,) for t in ("to a@b.co now, +1 555 555 0100", "clean", None, "", "ssn 123-45-6789 234-56-7890 x", "social security: 123-45-6789, 321-54-9876")], "text string").coalesce(1)
    assert [r.text for r in pii.redact(df).collect()] == ["to [EMAIL] now, [PHONE]", "clean", None, "", "ssn [SSN] [SSN] x", "social security: [SSN], [SSN]"]


def test_redaction_cuts_what_is_found(spark, docs):
    """Against the spans of ``find``, merged where they overlap; further columns pass through whatever their names."""
    rng = random.Random(9)
    bits = ["ssn ", "123-45-6789", ", ", "4111 1111 1111 1111", "378282246310005", "card ", "é", "a@b.co", " 1.2.3.4", "+1 555 555 0100", "GB82WEST12345698765432", " ", "-", "word"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(800)] + [" ".join(rng.choice(bits) for _ in range(4000))]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(made)], "doc_id long, text string, __m string, __t string, spans string")
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.find(df).select("doc_id", "spans").collect()}
    order = [k.name for k in pii.KINDS]
    got = pii.redact(df)
    assert got.columns == df.columns
    for r in got.collect():
        out, at, end, t = [], 0, 0, made[r.doc_id]
        for a, b, k in sorted(found[r.doc_id], key=lambda s: (s[0], order.index(s[2]))):
            if a >= end:
                out += [t[max(at, end) : a], f"[{k.upper()}]"]
                at = a
            end = max(end, b)
        assert r.text == "".join(out) + t[end:] and (r["__m"], r["__t"], r.spans) == ("x", "y", "z")


# --- classifier -------------------------------------------------------------------


def test_classifier(spark, docs, nothing):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choices(["river", "stone", "walked", "under", "morning", "light", "the", "of", "quiet"], k=60))
    bad = lambda: " ".join(rng.choices(["BUY$$$", "now!!!", "win###", "click>>", "free***", "$$$"], k=60))
    made = [(i, good() if i % 2 else bad(), i % 2) for i in range(300)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in made] + [(None, 1), (999, None), (1, 1)], "doc_id long, quality int")
    model = classifier.learn(texts, labels.filter("doc_id % 3 <> 0 OR doc_id IS NULL"))
    got = {r.doc_id: r.score for r in classifier.score(texts, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, _, q in made if i % 3 == 0]) > 0.97
    awkward = classifier.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in awkward) and len({r.score for r in awkward if not r.text}) == 1
    assert {r.score for r in awkward if r.text == "same text"} == {next(r.score for r in awkward if r.text == "same text")}
    assert classifier.score(nothing, model).count() == 0
    none = classifier.learn(texts, labels.filter("quality = 1"))
    assert {r.score for r in classifier.score(texts, none).collect()} == {1.0}
    assert {r.score for r in classifier.score(texts, classifier.learn(texts, labels.limit(0))).collect()} == {0.5}


# --- chat ------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/s[]INSTROLE\\| |endoftx", max_size=40))
def test_escapes_are_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_chat_round_trip(spark):
    said = [t or "" for t in AWKWARD[:7]] + ["</s>", "[\\INST]", "<s><\\s>", "é</s>é"]
    made = [(c, t, r, x) for c in (5, -1, None) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "tool [/ROLE]", None, "assistant"] * 3, said, strict=False))]
    made += [(9, 0, "assistant", "again"), (9, 0, "assistant", "again"), (9, None, "user", None)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).repartition(3)
    path = tokenizer("byte_bpe_50k.json")
    formatted = chat.format_chats(df, path)
    got = {r.conv_id: r for r in chat.digests(formatted, path).collect()}
    by = defaultdict(list)
    for c, t, r, x in made:
        by[c].append(((-1 if t is None else t), r or "", x or ""))
    assert set(got) == set(by)
    for c, v in by.items():
        v.sort(key=lambda x: x[0])
        loss = "".join(x for _, r, x in v if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in v).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(v), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for c in by:  # the mask's spans follow from running lengths
        at = 0
        for r in [r for r in formatted.collect() if r.conv_id == c]:
            assert r.start == at and (r.loss_start is None or at <= r.loss_start <= r.loss_end <= at + len(r.ids) // 4)
            at += len(r.ids) // 4
    assert chat.digests(chat.format_chats(df.limit(0), path), path).count() == 0


# --- packing ----------------------------------------------------------------------


def check_pieces(pieces, texts, enc, window):
    by, seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for name in {t[0] for t in texts}:
        want = Counter(say(whole(enc, t[1])) for t in texts if t[0] == name)
        if sum(want.values()) == 1:
            own = sorted(by[name], key=lambda r: r.start)
            assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
            assert b"".join(bytes(r.ids) for r in own) == next(iter(want)) and {r.doc_tokens for r in own} == {sum(r.length for r in own)}
        assert sum(r.length for r in by[name]) * 4 == sum(len(k) * n for k, n in want.items())
    for own in seq.values():
        own.sort(key=lambda r: r.offset)
        size = 0
        for r in own:
            assert r.offset == size and len(r.ids) == 4 * r.length
            size += r.length
        assert size == window or (size < window and size & (size - 1) == 0)


def test_packing(spark, docs, nothing, monkeypatch):
    enc = encoding.encoder(tokenizer("word_bpe_49k.json"), "word", 2)
    check_pieces(packing.pack(docs, tokenizer("word_bpe_49k.json")).collect(), rows(), enc, 4096)
    check_pieces(packing.pack(docs, tokenizer("word_bpe_49k.json"), window=64).collect(), rows(), enc, 64)
    assert packing.pack(nothing, tokenizer("word_bpe_49k.json")).count() == 0


def test_neighbours_are_by_score():
    rng = np.random.default_rng(1)
    rests = [rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint16) for _ in range(50)]
    df = np.bincount(np.concatenate([np.unique(r) for r in rests]), minlength=60)
    idf = np.where(df <= 30, np.log(1 + (50 - df + 0.5) / (df + 0.5)), 0).astype(np.float32)
    mean = np.mean([len(r) for r in rests])
    index = packing.Index(rests, idf, mean)
    index.used[[3, 7]] = True

    def score(seed, d):
        n = Counter(rests[d].tolist())
        return sum(idf[t] * n[t] * 2.2 / (n[t] + 1.2 * (0.25 + 0.75 * len(rests[d]) / mean)) for t in set(rests[seed].tolist()) if n[t] and idf[t] > 0)

    got = list(dict.fromkeys(index.neighbours(3)))
    assert set(got) == set(range(50)) - {3, 7}
    scores = [score(3, d) for d in got]
    assert all(a >= b - 1e-4 for a, b in zip(scores, scores[1:], strict=False))


def test_common_ids_find_neighbours_too(spark):
    """Two topics that half of all documents hold each: no id is rare."""
    rng = random.Random(3)
    topics = [["river", "stone", "water", "boat", "fish"], ["music", "piano", "opera", "sound", "voice"]]
    texts = [" ".join(rng.choices(topics[i % 2], k=40)) for i in range(16)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokens = packing.tokenized(df, tokenizer("word_bpe_49k.json"), "word", 2)
    idf, mean = packing.weights(tokens, 2)
    got = tokens.orderBy("doc_id").collect()
    rests = [np.frombuffer(bytes(r.ids), np.uint16) for r in got]
    assert (idf[np.unique(np.concatenate(rests))] > 0).all()
    index = packing.Index(rests, idf, mean)
    index.used[0] = True
    assert {i % 2 for i in list(dict.fromkeys(index.neighbours(0)))[:7]} == {0}


def naive_pack(docs, idf, mean, window):
    """Windows filled one rest at a time, each scored against all that are left."""
    out, seq, rest = [], 0, {}
    for i, d in enumerate(docs):
        for at in range(0, len(d) // window * window, window):
            out.append((i, at, window, seq, 0))
            seq += 1
        if len(d) % window:
            rest[i] = d[len(d) // window * window :].tolist()
    count = {i: Counter(r) for i, r in rest.items()}

    def score(a, b):
        k = 1.2 * (1 - 0.75 + 0.75 * len(rest[b]) / max(mean, 1.0))
        return sum(float(idf[t]) * n * (1.2 + 1) / (n + k) for t in sorted(count[a]) if idf[t] > 0 and (n := count[b][t]))

    unused, left, here, place = list(rest), sum(map(len, rest.values())), None, 0
    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        filled, seed = 0, here
        while filled < room:
            if here is None:
                here, place = unused[0] if seed is None else min(unused, key=lambda d: (-score(seed, d), d)), 0
                unused.remove(here)
                seed = here if seed is None else seed
            n = min(room - filled, len(rest[here]) - place)
            out.append((here, len(docs[here]) // window * window + place, n, seq, filled))
            filled, place = filled + n, place + n
            here = None if place == len(rest[here]) else here
        left, seq = left - room, seq + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_a_shard_packs_as_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 40 * (i % 3 + 1), rng.integers(1, 150 if i % 9 else 400)).astype(np.uint16) for i in range(90)]
    docs += [docs[3], docs[3], docs[10]]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=120)
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = float(np.mean([len(d) for d in docs]))
    assert list(packing.pack_shard(docs, idf, mean, 128)) == naive_pack(docs, idf, mean, 128)


def test_similar_documents_share_sequences():
    topics = [np.arange(100 * k, 100 * k + 100) for k in range(8)]
    rng = np.random.default_rng(2)
    docs = [rng.choice(topics[i % 8], 120).astype(np.uint16) for i in range(64)]
    idf = np.ones(800, np.float32)
    seq = defaultdict(set)
    for i, _, _, s, _ in packing.pack_shard(docs, idf, 120.0, 512):
        seq[s].add(i % 8)
    assert np.mean([len(x) for x in seq.values()]) < 2.5


# --- media ----------------------------------------------------------------------


def test_media(spark, docs, nothing):
    stored = media.text_media(docs)
    got = media.features(stored).collect()
    assert len(got) == len(rows())
    by = defaultdict(set)
    for r in got:
        assert media.from_wav(bytes(r.media)) == bytes(r.payload) and len(r.payload) % 64 == 0 and len(r.payload) > 0
        by[bytes(r.payload)].add((bytes(r.media), tuple(r.fingerprint), r.frames))
    assert all(len(v) == 1 for v in by.values())
    want = Counter((t or "").encode() + bytes(-len((t or "").encode()) % 64 if t else 64) for _, t, *_ in rows())
    assert Counter(bytes(r.payload) for r in got) == want
    assert media.features(media.text_media(nothing)).count() == 0


def test_blocks_find_the_same_peaks(monkeypatch):
    x = LONG[:20_000].encode()
    t, f, n = media.peaks(x)
    monkeypatch.setattr(media, "BLOCK", 7)
    t2, f2, n2 = media.peaks(x)
    assert n == n2 and (t == t2).all() and (f == f2).all()


def test_tone_has_its_bin():
    tone = (128 + 100 * np.sin(2 * np.pi * 16 * np.arange(4096) / 256)).astype(np.uint8).tobytes()
    t, f, n = media.peaks(tone)
    assert n == 31 and Counter(f.tolist()).most_common(1)[0][0] == 16
    codes, _ = media.fingerprint(tone)
    assert (np.diff(codes & (2**40 - 1)) >= 0).all()


def test_different_texts_have_different_peaks():
    """Short prose: the level of its letters is no content."""
    rng = random.Random(6)
    words = ["the", "of", "and", "house", "river", "stone", "light", "under", "over", "green", "walk", "told"]
    raw = [" ".join(rng.choices(words, k=60)).encode() for _ in range(200)]
    found = [media.peaks(x + bytes(-len(x) % 64)) for x in raw]
    assert len({(tuple(t), tuple(f)) for t, f, _ in found}) == len(set(raw))
    assert np.mean(np.concatenate([f for _, f, _ in found]) == 1) < 0.25
    assert not len(media.peaks(bytes([90]) * 1000)[0]) and not len(media.peaks(bytes(64))[0])


# --- mixing -----------------------------------------------------------------------


def brute_targets(size, share=1.5, most=2):
    keys = sorted((k for k in size if k is not None)) + [None] * (None in size)
    w = {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    left, open_, target = share * sum(size.values()), set(keys), {}
    while True:
        level = left / sum(w[k] for k in open_) if open_ else 0
        full = {k for k in open_ if w[k] * level > most * size[k]}
        if not full:
            return target | {k: w[k] * level for k in open_}
        for k in full:
            target[k] = most * size[k]
            left -= target[k]
        open_ -= full


def test_mixing(spark, docs, nothing):
    size = defaultdict(int)
    for r in rows():
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(size)
    got = mixing.mix(docs.drop("size", "key", "h", "copies")).collect()
    assert len(got) == len(rows()) and {round(r.target, 6) for r in got} == {round(x, 6) for x in want.values()}
    assert all(0 <= r.copies <= 2 for r in got)
    again = mixing.mix(docs.repartition(5).drop("size", "key", "h", "copies")).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    want_rows = Counter()
    for r in got:
        want_rows[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in taken.select("doc_id").collect()) == +want_rows
    assert mixing.mix(nothing).count() == 0 and mixing.take(nothing).count() == 0


def test_mix_comes_near_targets(spark):
    rng = random.Random(5)
    made = [(i, "w " * rng.randint(1, 50), rng.choice(["hot"] * 6 + ["a", "b", "c", None])) for i in range(4000)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    size, taken, target = defaultdict(int), defaultdict(int), {}
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    for i, t, s in made:
        size[s] += t.count("w")
        taken[s] += got[i].size * got[i].copies
        target[s] = got[i].target
    want = brute_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 50


# --- pipeline ---------------------------------------------------------------------


def brute_copies(made):
    """How often each (id, text, source) is taken: hashes in order, up to the one where the source's budget ends or before it."""
    size, per = defaultdict(int), defaultdict(lambda: defaultdict(int))
    place = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    for i, t, s in made:
        n = len(WORD.findall(t or ""))
        size[s] += n
        per[s][place(i)] += n
    target, whole, limit = brute_targets(size), {}, {}
    for s in size:
        whole[s], limit[s], upto = min(2, int(target[s] // size[s])) if size[s] else 0, 0, 0
        budget = target[s] - whole[s] * size[s]
        for h in sorted(per[s]):
            if upto < budget <= upto + per[s][h]:
                limit[s] = h + (upto + per[s][h] - budget <= budget - upto)
            upto += per[s][h]
    return Counter(x for x in made for _ in range(whole[x[2]] + (place(x[0]) < limit[x[2]])))


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on what its predecessor kept; further columns named like results pass through."""
    import corpus_pipeline

    rng = random.Random(11)
    said = {"en": "the of and house river stone light under over green walk told seven quiet morning with shout thing", "fr": "les des maison fleuve pierre lumière sous vert marche dit sept matin avec chose quand déjà être une"}
    text = lambda lang, n: " ".join(rng.choices(said[lang].split(), k=n))
    made = [(i, text(("en", "fr")[i % 2], rng.randint(20, 200)), ("en", "fr")[i % 2], [None, "b", "a", "hot", "hot"][i % 5]) for i in range(200)]
    for k in range(60):  # near copies: a word at the end, or one in the middle
        base = made[rng.choice([4, 4, 4, 7, 50, 51])]
        t = base[1].split()
        t.insert(rng.choice([len(t), len(t) // 2]), "light")
        made.append((300 + k, " ".join(t), [base[2], None][k % 2], "copies"))
    made += [(400, made[5][1], "fr", "a"), (401, "12345 6789", "en", "b"), (402, None, "en", None), (403, "Ελληνικά κείμενα για τον ποταμό", None, "a"), (None, text("en", 40), None, "hot"), (404, " ".join(text("en", 200) for _ in range(60)), None, "long")]
    made += [(405 + i, f"write to me{i}@example.com about 10.0.0.{i} or +1 555 010 99{i:02d}, {text('en', 40)}", "en", "hot") for i in range(20)]
    rows_ = [(i, t, lang, s, len(t or ""), "x", "y", "z") for i, t, lang, s in made]
    spark.createDataFrame(rows_, SCHEMA + ", key string, h string, spans string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = [tuple(r) for r in docs.collect()] if k < 4 else docs.collect()

    french = lambda t: "maison" in t or "fleuve" in t or "pierre" in t
    known = [(i, t, lang or ("fr" if french(t) else "en"), *rest) for i, t, lang, *rest in rows_ if i not in (401, 402, 403)]
    assert Counter(seen["language_id"]) == Counter(known)

    sets = [(lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})(r[1].split()) for r in known]
    group = list(range(len(known)))
    for _ in range(3):
        for x in range(len(known)):
            for y in range(x):
                if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                    group[x] = group[y] = min(group[x], group[y])
    first = {}
    for r, g in zip(known, group, strict=True):
        first[g] = min(first.get(g, r), r, key=lambda x: -1 if x[0] is None else x[0])
    assert Counter(seen["simhash_dedup"]) == Counter(first.values()) and len(first) <= len(known) - 55

    clean = []
    for r in first.values():
        t = r[1]
        for k, a, b in sorted(brute_spans(t), key=lambda x: -x[1]):
            t = f"{t[:a]}[{k.upper()}]{t[b:]}"
        clean.append((r[0], t, r[2], r[3], len(t), *r[5:]))
    assert Counter(seen["pii"]) == Counter(clean) and sum("[EMAIL] about [IP] or [PHONE]," in r[1] for r in clean) == 20

    assert Counter((r[0], r[1], r[3]) for r in seen["mix_sources"]) == brute_copies([(r[0], r[1], r[3]) for r in clean])
    assert set(seen["mix_sources"]) <= set(clean)

    check_pieces(seen["packing"], seen["mix_sources"], encoding.encoder(tokenizer("word_bpe_49k.json"), "word", 2), 4096)
    ids = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids[r.doc_id] += r.length
    assert ids == sum((Counter({r.doc_id: r.length}) for r in seen["packing"]), Counter())


@pytest.mark.parametrize("which", ["awkward", "empty"])
def test_pipeline_on_awkward_tables(spark, tables, which):
    """Ids that repeat or are null, clashing names, a very long text, and nothing at all."""
    import corpus_pipeline

    path, made = tables[which]
    got = corpus_pipeline.run(spark, path).collect()
    assert bool(got) == bool(made) and {r.doc_id for r in got} <= {m[0] for m in made if m[1] and any(c.isalpha() for c in m[1])}


# --- classifier against brute force -------------------------------------------------------


def test_scores_by_brute_force(spark):
    """Sizes by zstandard itself, weights at a stationary point of the penalised likelihood, long labelled texts in pieces."""
    import zstandard

    rng = random.Random(12)
    words = {1: ["river", "stone", "walked", "light", "quiet"], 0: ["BUY$", "click>>", "free*", "river", "now!"]}
    texts = [" ".join(rng.choices(words[q] + words[1 - q][:2], k=rng.randint(5, 400))) for i in range(240) for q in [i % 2]]
    labels = [i % 2 for i in range(240)]
    model = classifier.fit([t.encode() for t in texts], labels)
    packers = [zstandard.ZstdCompressor(level=classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]

    def features(t):
        raw = t.encode()
        good, bad = (sum(len(p.compress(raw[i : i + classifier.PIECE])) for i in range(0, len(raw), classifier.PIECE)) for p in packers)
        size = (good + bad) / (2 * len(raw))
        return [1.0, 2 * (bad - good) / (good + bad), size, size * size]

    logit = lambda t: 1 / (1 + np.exp(-np.dot(model.weights, features(t))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in classifier.score(df, model).collect()}
    assert all(got[i] == pytest.approx(logit(t), abs=1e-4) for i, t in enumerate(texts))
    held = [i for i in range(240) if i % 3 == 2]
    assert np.mean([got[i] for i in held]) == pytest.approx(np.mean([labels[i] for i in held]), abs=0.02)
    long = "".join(f"{i:07d} " for i in range(20_000))
    cut = spark.createDataFrame([(long,), ("short",), (None,)], "text string").select(classifier.spread(F.col("text"), 4096).alias("t")).collect()
    assert len(cut[0].t) == 4096 and cut[0].t.startswith(long[:512]) and cut[0].t.endswith(long[-512:]) and (cut[1].t, cut[2].t) == ("short", None)


# --- the registered queries -----------------------------------------------------------

CONTRACT = {
    "op1_token_files": "doc_id start n_tokens ids_crc32",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op3_simhash_dedup": "doc_id fingerprint component_id",
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_quality_classifier": "doc_id held_out score predicted",
    "op7_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op10_mix_sources": "doc_id size source_size target taken",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of awkward tables and of empty ones: nulls, clashing names, repeated and null ids, ties, a text of some megabytes."""
    at = {}
    for name in ("awkward", "empty"):
        path = tmp_path_factory.mktemp(name)
        keep = F.lit(name == "awkward")
        made = rows() + [(90, "long text of words " * 150_000, "en", "hot", 0)]
        more = [c for c in CLASH if c not in ("ids", "id")]
        spark.createDataFrame(made, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in more}).filter(keep).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([(i, i % 2, 0, "clash") for i in range(19)] + [(None, 1, 0, "x"), (5, None, 0, "x")], "doc_id long, quality int, toxic int, score string").filter(keep).write.parquet(str(path / "labels.parquet"))
        said = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", None, "x"), (2, 0, None, "[INST]", "x"), (None, 0, "assistant", "a", "x"), (1, 2, "assistant", LONG, "x")]
        spark.createDataFrame(said, "conv_id long, turn long, role string, text string, ids string").filter(keep).write.parquet(str(path / "conversations.parquet"))
        at[name] = str(path), made if name == "awkward" else []
    return at


@pytest.mark.parametrize("which", ["awkward", "empty"])
@pytest.mark.parametrize("name", CONTRACT)
def test_registered_query(spark, tables, name, which):
    from tidegauge.llm.queries import QUERIES

    path, made = tables[which]
    out = QUERIES[name](spark, path)
    assert out.columns == CONTRACT[name].split()
    got = out.collect()
    if name == "op7_chat_format":
        assert len(got) == (4 if made else 1) and [r.n_turns for r in got if r.conv_id == -1] == [2]
        return
    assert Counter(r.doc_id for r in got if name != "op8_packing" or r.start == 0) == Counter(m[0] for m in made)
    crc = lambda i: zlib.crc32(str(i if i is not None else "").encode())
    if name in ("op2_language_id", "op6_quality_classifier"):
        assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    if name == "op1_token_files":
        tok = encoding.encoder(tokenizer("byte_bpe_50k.json"), "byte", 2).tok
        want = Counter((m[0], len(x), zlib.crc32(say(x))) for m in made for x in [tok.encode(m[1] or "", add_special_tokens=False).ids + [2]])
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        upto = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == upto
            upto += r.n_tokens
    if name == "op3_simhash_dedup":
        assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((m[0], f"{brute_fingerprint(m[1]):016x}") for m in made)
    if name == "op8_packing":
        assert {r.doc_id: r.doc_tokens for r in got if r.doc_id == 90} in ({}, {90: 600_001})
        used = defaultdict(list)
        for r in got:
            used[r.sequence_id].append((r.offset, r.length))
        for v in used.values():
            v.sort()
            assert [o for o, _ in v] == list(np.cumsum([0] + [n for _, n in v[:-1]])) and sum(n for _, n in v) <= 4096
    if name == "op9_media_columns":
        raw = lambda t: (t or "").encode() + bytes(-len((t or "").encode()) % 64 if t else 64)
        assert Counter((r.doc_id, r.payload_sha256, r.tail_crc32) for r in got) == Counter((m[0], hashlib.sha256(raw(m[1])).hexdigest(), zlib.crc32(raw(m[1])[-64:])) for m in made)
