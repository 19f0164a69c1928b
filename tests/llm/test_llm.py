"""Small tables with nulls, empty texts, repeats and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanmoa.llm import components, crossparse, hyperminhash, kneserney, packing, positional, sharding, suffixruns, templates, tokenfile, weighted
from hanmoa.llm.tokens import Encoder

vocabularies = pytest.importorskip("public_tokenizers")
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "ÄÖ", "x.y", "mu", "nu"]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(n))


def table(spark, rows):
    """doc_id and text, with columns that clash with names used inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("row", "rank", "component", "bytes", "band", "part", "run")})


@pytest.fixture(scope="module")
def docs(spark):
    near = text(3, 60)
    rows = [(i, text(i, 40)) for i in range(10)] + [(20, near), (21, near + " end"), (22, near), (23, None), (24, ""), (25, "one"), (26, "one"), (27, text(9, 40) + text(1, 40))]
    return rows, table(spark, rows)


def test_sharding(spark, docs):
    rows, df = docs
    got = sharding.shard_rows(df, 4).collect()
    assert len(got) == len(rows)
    by = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)]
    assert all(b == list(range(len(b))) for b in by) and max(map(len, by)) - min(map(len, by)) <= 1
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert sharding.shard_rows(table(spark, []), 4).count() == 0


def test_ring_moves_little():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 20000)

    def place(shards):
        at, owner = sharding.ring(shards, 64)
        arc = np.searchsorted(at, h) % len(at)
        out = np.empty(len(h), dtype=int)
        order = np.lexsort((h, arc))
        first = np.searchsorted(arc[order], np.arange(len(at)))
        for a, low, high, s, _ in sharding.walk(np.bincount(arc, minlength=len(at)), owner, sharding.capacities(len(h), shards, 0.25)):
            out[order[first[a] + low : first[a] + high]] = s
        return out

    a, b = place(16), place(17)
    assert np.bincount(a).max() <= 1.25 * len(h) / 16 + 1
    assert (a != b).mean() < 0.25


def test_ring_of_equal_counts_moves_less_than_dealing_anew():
    """With epsilon 0, as the query has it, counts are at most one apart and most rows stay where they were."""
    h = np.sort(np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 40_000))

    def place(shards):
        at, owner = sharding.ring(shards, 512)
        arc = np.searchsorted(at, h) % len(at)
        order = np.lexsort((h, arc))
        first = np.searchsorted(arc[order], np.arange(len(at)))
        out = np.empty(len(h), dtype=int)
        for a, low, high, s, _ in sharding.walk(np.bincount(arc, minlength=len(at)), owner, sharding.capacities(len(h), shards, 0.0)):
            out[order[first[a] + low : first[a] + high]] = s
        return out

    a, b = place(16), place(17)
    moved = (a != b).mean()
    print("moved", moved)
    assert np.ptp(np.bincount(a)) <= 1 and np.ptp(np.bincount(b)) <= 1 and 1 / 17 <= moved < 0.3


def test_near_duplicates(spark, docs):
    rows, df = docs
    got = {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in hyperminhash.near_duplicates(df, 5, 80).collect()}
    assert got[21][:2] == (20, False) and got[22][:2] == (20, False) and got[26] == (25, False, 1)
    assert got[23] == (23, True, 0) and got[24] == (24, True, 0) and got[5][:2] == (5, True)
    assert hyperminhash.near_duplicates(table(spark, []), 5, 80).count() == 0


def test_registers_estimate():
    r = np.random.default_rng(5)
    for n, shared in ((2000, 1800), (400, 200), (30, 27)):
        err = []
        for _ in range(30):
            x = r.integers(0, 2**64 - 1, 2 * n, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:shared], x[n : 2 * n - shared]]))
            regs = hyperminhash.registers([a, b])
            err.append(hyperminhash.estimate(np.array([(regs[0] == regs[1]).sum()]))[0] - shared / (2 * n - shared))
        assert abs(np.mean(err)) < 0.05


def sets_by_force(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components_by_force(rows, percent):
    sets = {i: sets_by_force(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components_by_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(1)
    links = [(r.randrange(-40, 300), r.randrange(-40, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 3), (5, 5), (4, None)]
    label = {i: i for link in links for i in link if i is not None}
    for _ in label:
        for a, b in links:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(links, "a long, b long"), "test")
    assert {(r["id"], r["component"]) for r in got.collect()} == {(i, c) for i, c in label.items() if i != c}
    assert components.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


@pytest.mark.parametrize("tile", [512, 2, 5])
def test_near_duplicates_by_brute_force(spark, monkeypatch, tile):
    """Chains of edits, a tight group and lone texts, in whole groups and in groups cut into blocks."""
    monkeypatch.setattr(hyperminhash, "TILE_ROWS", tile)
    r, rows = random.Random(6), []
    for _ in range(6):
        w = text(r.random(), 70).split()
        for _ in range(9):
            rows.append(" ".join(w))
            for _ in range(2):
                w[r.randrange(len(w))] = str(r.random())
    tight = text(1, 80)
    rows += [f"{tight} tail{i}" for i in range(25)] + [text(77 + i, 30) for i in range(8)] + ["A b", "a  B", "a b c", "", None, "x" * 9000]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    for percent in (80, 85):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in hyperminhash.near_duplicates(table(spark, rows), 5, percent).collect()}
        assert got == components_by_force(rows, percent)


def test_repeated_passages(spark):
    passage = "a passage of more than fifty bytes that several documents repeat as it is, with ü "
    rows = [(1, "x" * 30 + passage), (2, passage + "y" * 70), (3, "zz " + passage[:49]), (4, None), (5, ""), (6, passage * 3), (6, passage), (7, "y" * 60), (None, passage)]
    got = {}
    for r in suffixruns.repeated_passages(table(spark, rows), keep_text=True).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    for i in {r[0] for r in rows}:
        expect = []
        for d, t in rows:
            if d != i:
                continue
            b = (t or "").encode()
            gone = np.zeros(len(b), dtype=bool)
            for k in range(len(b) - 49):
                if i is not None and any(b[k : k + 50] in (u or "").encode() for e, u in rows if e is not None and e < i):
                    gone[k : k + 50] = True
            kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
            expect.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest()))
        assert sorted(got[i]) == sorted(expect), i
    assert suffixruns.repeated_passages(table(spark, [])).count() == 0


def test_loser_tree_merges_in_order():
    r = random.Random(2)
    runs = [sorted({bytes(r.choice(b"ab") for _ in range(suffixruns.KEY)) for _ in range(r.randrange(0, 40))}) for _ in range(7)]
    coded = [suffixruns.front_code(np.frombuffer(b"".join(k), dtype=np.uint8).reshape(len(k), -1)) if k else (b"", b"") for k in runs]
    got = list(suffixruns.merge([suffixruns.decode(*c) for c in coded]))
    keys = [k.to_bytes(suffixruns.KEY, "big") for k, _, _ in got]
    assert keys == sorted(k for run in runs for k in run)
    for a, b, (_, shared, _) in zip(keys, keys[1:], got[1:], strict=False):
        assert shared == next((i for i in range(len(a)) if a[i] != b[i]), len(a))


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(t):
    return ITEM_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def item_windows(t, width=13):
    w = item_words(t)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def hits_by_force(t, items):
    """n_words, n_hit and the sorted ids of items that occur."""
    w = item_words(t)
    hit, found = set(), set()
    for item, u in items:
        for window in item_windows(u):
            for at in range(len(w) - len(window) + 1):
                if tuple(w[at : at + len(window)]) == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item) if item is not None else "")
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_contamination_by_brute_force(spark, docs, monkeypatch, sent):
    """Phrases sent to all blocks, and those dealt by their rarest term."""
    monkeypatch.setattr(positional, "SENT_BYTES", sent)
    monkeypatch.setattr(positional, "BLOCK_TOKENS", 60)
    rows, df = docs
    more = [(30, "ÄÖ ÄÖ-ÄÖ " * 9), (31, "one, ONE two"), (None, text(3, 60)), (32, text(40, 7000) + " one " + text(3, 60))]
    df = df.unionByName(table(spark, more))
    r = random.Random(8)
    items = [(i, " ".join((rows[i][1] or "").split()[r.randrange(20) :][: r.randrange(5, 25)]).upper()) for i in range(12)]
    items += [(1, items[1][1]), (50, "ONE"), (51, None), (52, ""), (53, "-- !"), (54, "ÄÖ" + " ÄÖ" * 14), (55, "one one"), (None, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit(1))
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in positional.contamination(df, bench).collect()), key=str)
    expect = [(i or 0, *hits_by_force(t, items)) for i, t in rows + more]
    assert got == sorted(((*e, e[2] > 0 and 20 * e[2] >= e[1]) for e in expect), key=str)
    assert sum(e[2] > 0 for e in expect) > 10
    assert positional.contamination(table(spark, []), bench).count() == 0
    assert positional.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_proximity_stays_within_documents(spark, monkeypatch, sent):
    monkeypatch.setattr(positional, "SENT_BYTES", sent)
    rows = [(1, "a b"), (2, "c d"), (3, "b x c"), (4, "c b"), (5, "b c b c"), (6, None), (7, "b y y c")]
    bench = spark.createDataFrame([(9, "b c")], "item_id long, text string")
    for slop, expect in ((0, {5: 2}), (1, {3: 1, 5: 2}), (2, {3: 1, 4: 1, 5: 2, 7: 1})):
        index = positional.build_index(table(spark, rows).coalesce(1))
        got = {r["doc_id"]: r["n_matches"] for r in positional.find_near(index, bench, slop).collect()}
        assert got == expect, slop


def test_elias_fano():
    r = np.random.default_rng(3)
    for values in ([], [0], [5, 5, 5], np.sort(r.integers(0, 10**6, 3000))):
        ef = tokenfile.EliasFano.encode(np.array(values, dtype=np.int64))
        assert ef.values().tolist() == list(values)
        assert [ef.select(i) for i in range(len(values))] == list(values)
        assert tokenfile.EliasFano.load(ef.dump()).values().tolist() == list(values)


def test_token_file_and_packing(spark, docs):
    rows, df = docs
    path = vocabularies.path("byte_bpe_50k.json")
    e = Encoder(path)
    ids = {i: [*np.frombuffer(e._whole(t or ""), dtype=e.kind).tolist(), 0] for i, t in rows}
    start = 0
    for r in tokenfile.read_token_file(tokenfile.write_token_file(df, path, 0), with_ids=True).orderBy("doc_id").collect():
        assert r["start"] == start and r["ids"] == ids[r["doc_id"]]
        start += r["n_tokens"]
    got = packing.pack_documents(df, path, 0, capacity=64, with_ids=True).collect()
    parts, filled = {}, {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in parts.items()} == ids
    for v in filled.values():
        assert [o for o, _ in sorted(v)] == list(np.cumsum([0, *[n for _, n in sorted(v)]])[:-1]) and sum(n for _, n in v) <= 64
    assert tokenfile.read_token_file(tokenfile.write_token_file(table(spark, []), path, 0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    from tokenizers import Tokenizer

    e, bare = Encoder(vocabularies.path(name)), Tokenizer.from_file(vocabularies.path(name))
    r = random.Random(3)
    bits = ["the", "It's", "don't", " ", "  ", "\n", "\n ", "\t", "\xa0", "\x1c", ".", "***", "23", "²", "é", "ß", "α", "日本", "한글", "́", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "İ"]
    texts = ["".join(r.choices(bits, k=r.randrange(12))) for _ in range(2000)]
    assert [np.frombuffer(x, dtype=e.kind).tolist() for x in e.encode(texts)] == [bare.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_file_keeps_all_doc_ids(spark):
    path = vocabularies.path("byte_bpe_50k.json")
    rows = [(None, "b"), (None, None), (-(2**63), "x"), (-5, ""), (-5, "a a"), (0, "y " * 5000), (2**63 - 1, "z"), (2**63 - 1, "z")]
    got = tokenfile.read_token_file(tokenfile.write_token_file(table(spark, rows), path, 0)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in rows] and got[5]["n_tokens"] > 5000


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    """A text without blanks, and the end of a long one, count; texts beyond the bound of bytes aren't drawn."""
    rows = [(i, text(i, 3000) + (" vilestem" if i % 2 else "")) for i in range(24)] + [(50 + i, "-".join(["calm", str(i), "vilestem" if i % 2 else "x"])) for i in range(24)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(kneserney, "HELD_FOR_SCALE", 1_000_000)
    model = kneserney.train(table(spark, rows), labels)
    assert model.of_words([b"vilestem"])[0] > 0
    monkeypatch.setattr(kneserney, "SAMPLE_BYTES", 60_000)
    assert kneserney.train(table(spark, rows), labels).of_words([b"vilestem"])[0] > 0
    empty = kneserney.train(table(spark, []), labels)
    assert kneserney.score_documents(table(spark, []), empty).count() == 0 and kneserney.keep_ordinary(table(spark, [(1, None), (1, None)]), empty).count() == 2


def test_toxicity(spark):
    rows = [(i, text(i, 30) + (" vilestem" + random.Random(i).choice(["er", "ing", "ed", "o"]) + " grubby" if i % 4 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 300, 2)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    df = table(spark, [*rows, (900, None), (901, "")])
    model = kneserney.train(df, labels)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in kneserney.score_documents(df, model).collect()}
    right = sum(got[i][1] == int(i % 4 == 0) for i in range(1, 300, 2)) + sum(got[i][1] == int(i % 4 == 0) for i in range(0, 300, 2))
    assert right >= 290 and all(0 <= s <= 1 for s, _ in got.values()) and got[900] == got[901]
    nothing = kneserney.train(df, labels.limit(0))
    assert kneserney.score_documents(df, nothing).where("predicted = 1").count() == 0


def test_language(spark):
    one, two = ["foo", "bar", "baz", "qux"], ["lorem", "ipsum", "dolor", "amet"]
    rows = [(i, " ".join(random.Random(i).choices(one if i % 2 else two, k=20)), "a" if i % 2 else "b") for i in range(60)]
    df = spark.createDataFrame([*rows, (90, None, "a"), (91, "12 !", None), (92, "x" * 5000, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in crossparse.identify(df, crossparse.train(df)).collect()}
    assert all(got[i] == lang for i, _, lang in rows) and got[90] == got[91] == "und" and got[92] in ("a", "b")
    auto = crossparse.SuffixAutomaton([1, 2, 1, 3])
    assert auto.contains([2, 1, 3]) and not auto.contains([1, 1])


def test_fingerprints(spark, docs):
    rows, df = docs
    got = {r["doc_id"]: r for r in weighted.compare_edited(df).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[20]["fingerprint"] == got[22]["fingerprint"] and got[23]["fingerprint"] == got[24]["fingerprint"]
    assert weighted.compare_edited(table(spark, [])).count() == 0
    assert weighted.compare_edited(table(spark, [(1, "a b c d")])).count() == 1


def test_templates(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>m</ul></nav><div class='ad'>buy</div><article><h1>A &amp;&nbsp;B</h1><p>x<b>y</b>\n z<br>w<script>'</p>'</script><p>last<div id=comments-2>no</div></article><footer>f</footer>"
    bare = "<body><div class=sidebar>s</div><div>story {} text</div><form>q</form><div>same</div></body>"
    rows = [(1, "http://A.com/x", page), (2, "http://a.com/y", page), (3, None, None), (4, "http://b.org", ""), *((10 + i, "http://c.net/", bare.format(i)) for i in range(4))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "template": F.lit("x")})
    got = {r["page_id"]: r for r in templates.extract_text(df).collect()}
    assert got[1]["text"] == got[2]["text"] == "A & B\n\nxy z w\n\nlast" and got[3]["text"] == got[4]["text"] == "" and got[11]["text"] == "story 1 text"
    assert templates.extract_text(df.limit(0)).count() == 0


def test_fingerprint_likeness_follows_generalised_jaccard():
    r = random.Random(4)
    sampler, errors = weighted.Sampler(kept=200), []
    for _ in range(150):  # the sampler forgets meanwhile
        words = [str(r.randrange(10**9)) for _ in range(60)]
        a = {w: r.randrange(1, 5) for w in words[:45]}
        b = a | {w: r.randrange(1, 6) for w in words[: r.randrange(30)]} | dict.fromkeys(words[45 : 45 + r.randrange(15)], 1)
        texts = [" ".join(w for w, n in bag.items() for _ in range(n)).encode() for bag in (a, b)]
        prints = sampler.fingerprints(texts)
        assert (weighted.Sampler().fingerprints(texts) == prints).all()
        both = a.keys() | b.keys()
        true = sum(min(a.get(w, 0), b.get(w, 0)) for w in both) / sum(max(a.get(w, 0), b.get(w, 0)) for w in both)
        errors.append(weighted.likeness(prints[:1], prints[1:])[0] - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_near_columns_compare_with_the_edited_and_the_next_text(spark, docs):
    rows, df = docs
    rows = sorted(rows)
    prints = weighted.Sampler().fingerprints([(t or "").encode() for _, t in rows])
    for r in weighted.compare_edited(df).collect():
        k = [i for i, _ in rows].index(r["doc_id"])
        after = weighted.likeness(prints[k : k + 1], np.roll(prints, -1, axis=0)[k : k + 1])[0]
        assert r["near_next"] == pytest.approx(after) and r["fingerprint"] == prints[k].tobytes().hex()
        edited = np.frombuffer(bytes.fromhex(r["edited_fingerprint"]), dtype=np.uint8)[None]
        assert r["near_edited"] == pytest.approx(weighted.likeness(prints[k : k + 1], edited)[0])


def test_fingerprints_of_a_doc_id_that_many_rows_have(spark):
    rows = [(7, text(i, 9)) for i in range(60)] + [(None, text(99 + i, 9)) for i in range(30)] + [(9, "x"), (9, "x"), (8, "w" * 9000)]
    got = weighted.compare_edited(table(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(r["n_chars"] for r in got) == sorted(len(t) for _, t in rows)
    bounds = np.array([3.0, 7.0, 7.0, 7.0, 8.0])
    hashes = np.linspace(-(2.0**63), 2.0**63 - 2048, 40).astype(np.int64)
    numbers = weighted.range_numbers(bounds, np.full(40, 7.0), hashes)
    assert set(numbers) == {1, 2, 3, 4} and (np.diff(numbers) >= 0).all()
    assert weighted.range_numbers(bounds, np.array([2.0, 4.0, 7.5, 9.0]), hashes[:4]).tolist() == [0, 1, 4, 5]
