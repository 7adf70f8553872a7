"""Each operator against a plain version of what it has to find."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import bpe, components, decontaminate, exact, frames, lines, pii, sais, similar, simhash, suffix, tagger, toxicity, urls
from strandline.llm.places import placed
from strandline.scratch import stored

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


def texts(seed, count, words=("ab", "cd", "ef", "gh", "ij", "kl", "mn"), longest=60):
    make = random.Random(seed)
    return [" ".join(make.choice(words) for _ in range(make.randint(0, longest))) for _ in range(count)]


def frame(spark, contents):
    return stored(spark.createDataFrame(list(enumerate(contents)), "doc_id bigint, text string"), "contents")


def test_bpe_as_the_library():
    make = random.Random(1)
    cases = ["", "a<|endoftext|>b <|startoftext|>", "ÀÉ ΣΑΣ İ ﬁ éé '’s don't 12 ½", "a" * 5000, "ab" * 3000]
    cases += ["".join(make.choice("aeinrst 'sd\n.,é") for _ in range(200)) for _ in range(200)]
    ours = bpe.encoder(open(PATH, encoding="utf-8").read())
    library = Tokenizer.from_file(PATH)
    for case, found in zip(cases, ours.encode(cases), strict=True):
        assert np.frombuffer(found, np.int32).tolist() == library.encode(case, add_special_tokens=False).ids
    vocabulary = ours.vocabulary
    for word in ("hello", "thonreheedtion", "x" * 60):
        symbols = [vocabulary.ids[c] for c in word[:-1]] + [vocabulary.ids[word[-1] + "</w>"]]
        assert vocabulary._merge_short(symbols) == vocabulary._merge_long(symbols)


def test_words_are_forgotten_without_effect(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    ours = bpe.Encoder(bpe.encoder(open(PATH, encoding="utf-8").read()).vocabulary)
    case = "one two three four five one two"
    first = ours.encode([case])
    assert all(ours.encode([case, "six seven"])[0] == first[0] for _ in range(4))


@pytest.mark.parametrize("bits", [None, 2])
def test_exact_with_colliding_digests_and_many_batches(spark, bits):
    contents = [random.Random(i % 7).choice(["a", "b", "c", "d"]) + str(i % 9) for i in range(80)]
    docs = frame(spark, contents).repartition(8)
    digest = exact.sha256 if bits is None else lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, bits))
    found = exact.exact_dedup(docs, digest=digest, files_per_batch=2).collect()
    groups = collections.defaultdict(list)
    for i, content in enumerate(contents):
        groups[content].append(i)
    for row in found:
        same = groups[contents[row.id]]
        assert (row.keep_id, row.group_size, row.kept) == (max(same), len(same), row.id == max(same))


def test_dedup_state_goes_on(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, b"x", ("f", i)) for i in ids], "id bigint, digest binary, locator struct<file:string,row:bigint>")
    arrivals, state = str(tmp_path / "arrivals"), exact.DedupState(spark, str(tmp_path / "state"))
    for ids in ((1, 2), (5,), (3,)):
        rows(*ids).write.mode("append").parquet(arrivals)
        state.feed(arrivals)
    assert [(r.seen, r.keep.id) for r in state.groups().collect()] == [(4, 5)]


def plain_components(pairs):
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(label)}


def test_components(spark):
    make = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(make.randint(200, 400), make.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert found == plain_components(p for p in pairs if p[0] != p[1])


@pytest.mark.parametrize("rows_per_key", [simhash.ROWS_PER_KEY, 3, 60])
def test_near_pairs_link_all_within_four_bits(spark, rows_per_key):
    make = random.Random(6)
    prints = [make.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        seed = make.choice(prints)
        for _ in range(make.randint(1, 5)):
            seed ^= 1 << make.randrange(64)
        prints.append(seed)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_pairs(spark.createDataFrame([(s,) for s in signed], "fp bigint"), rows_per_key)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4]
    found = plain_components((r.u % (1 << 64), r.v % (1 << 64)) for r in links.collect())
    assert found == plain_components(pairs)


@pytest.mark.parametrize("sample", [0, similar.SAMPLE])
def test_near_copies_are_all_pairs_of_similar_shingles(spark, sample):
    make = random.Random(8)
    contents = ["", " ", "one two", "One two"]
    for base in [[f"w{make.randrange(400)}" for _ in range(make.randint(20, 120))] for _ in range(25)]:
        for _ in range(make.randint(2, 9)):
            own = list(base)
            for _ in range(make.randint(0, 3)):
                own[make.randrange(len(own))] = f"v{make.randrange(400)}"
            contents.append(" ".join(own + [f"c{i}" for i in range(make.choice([0, 12]))]))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in contents]
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, k) for i in range(len(sets)) for k in range(i) if alike(sets[i], sets[k])]
    docs = placed(frame(spark, contents)).select(F.struct(F.col("doc_id").alias("id"), F.col("_place").alias("place")).alias("who"), F.col("text").cast("binary").alias("data"))
    found = {r.who.id: r.least.id for r in similar.near_copies(docs, sample=sample).collect()}
    expected = plain_components(pairs)
    assert len(pairs) > 30 and found == {i: expected.get(i, i) for i in range(len(contents))}


def test_texts_of_one_template_do_not_meet(spark):
    """Texts that share 160 words and have 24 of their own are no copies of each other; two of them are there again, changed a little."""
    template = " ".join(f"common{i}" for i in range(160))
    contents = [template + "".join(f" own{i}x{j}" for j in range(24)) for i in range(600)]
    contents += [contents[3] + " more", contents[4].replace("common80", "other")]
    docs = frame(spark, contents)
    named = placed(docs).select(F.struct(F.col("doc_id").alias("id"), F.col("_place").alias("place")).alias("who"), F.col("text").cast("binary").alias("data"))
    real, seen = similar._verified, []
    similar._verified = lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest)
    try:
        out = similar.near_copies(named).filter("who != least").select("who.id", F.col("least.id").alias("least")).collect()
    finally:
        similar._verified = real
    assert {tuple(r) for r in out} == {(600, 3), (601, 4)}
    assert sum(seen) < 10


def test_large_groups_are_not_paired(spark):
    """Texts that share half of their words, and a group of copies changed in places of their own: pairs stay a few times the texts."""
    make = random.Random(10)
    template = " ".join(f"common{i}" for i in range(100))
    contents = [template + "".join(f" own{i}x{j}" for j in range(100)) for i in range(150)]
    base = [f"w{i}" for i in range(200)]
    for i in range(150):
        own = list(base)
        for place in make.sample(range(200), make.randint(1, 3)):
            own[place] = f"v{i}x{place}"
        contents.append(" ".join(own))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in contents]
    pairs = [(i, k) for i in range(len(sets)) for k in range(i) if 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k])]
    assert len(pairs) > 3000
    docs = frame(spark, contents)
    named = placed(docs).select(F.struct(F.col("doc_id").alias("id"), F.col("_place").alias("place")).alias("who"), F.col("text").cast("binary").alias("data"))
    real, seen = similar._possible, []
    similar._possible = lambda pairs, rows: seen.append(pairs.count()) or real(pairs, rows)
    try:
        found = {r.who.id: r.least.id for r in similar.near_copies(named, sample=0).collect()}
    finally:
        similar._possible = real
    expected = plain_components(pairs)
    assert found == {i: expected.get(i, i) for i in range(len(contents))}
    assert sum(seen) < 10 * len(contents)


def test_texts_that_share_many_shingles_meet_seldom(spark):
    """Texts just below the threshold share most of their first shingles: few of those are kept, and few make a pair again."""
    make = random.Random(11)
    contents = []
    for base in range(4):
        words, places = [f"b{base}w{i}" for i in range(400)], make.sample(range(4, 400, 6), 60)
        for text in range(12):
            own = list(words)
            for place in places[5 * text : 5 * text + 5]:
                own[place] = f"v{base}x{text}x{place}"
            contents.append(" ".join(own))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in contents]
    pairs = [(i, k) for i in range(len(sets)) for k in range(i) if 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k])]
    docs = frame(spark, contents)
    named = placed(docs).select(F.struct(F.col("doc_id").alias("id"), F.col("_place").alias("place")).alias("who"), F.col("text").cast("binary").alias("data"))
    linked, unlinked, seen = similar._linked, similar._unlinked, []
    similar._linked = lambda sure, met, verified: seen.append(met.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "short")))).collect()) or linked(sure, met, verified)

    def noted(told, mains):
        found = unlinked(told, mains)
        seen.append((found.count(), found.distinct().count()))
        return found

    similar._unlinked = noted
    try:
        found = {r.who.id: r.least.id for r in similar.near_copies(named, sample=0).collect()}
    finally:
        similar._linked, similar._unlinked = linked, unlinked
    expected = plain_components(pairs)
    assert found == {i: expected.get(i, i) for i in range(len(contents))}
    keys, (rows, distinct) = seen
    assert len({str(sets) for _, sets in keys}) == len(keys) > 20
    assert 100 < distinct <= rows <= 2 * distinct  # equally large sets from either side


def test_shingles_of_one_text_are_left_where_hashes_are_small(spark):
    make = random.Random(12)
    keys = [sorted(make.sample(range(1 << 61), 500)) for _ in range(40)]
    rows = spark.createDataFrame([(bytes([i]) * 16, 2500, k) for i, k in enumerate(keys)], "node binary, n int, keys array<bigint>")
    assert similar._entries(rows).count() < 0.05 * 20_000


def test_near_copies_are_linked_by_fingerprints_first(spark):
    """Texts a few bits apart are met by SimHash; a template's texts, which are too, are told apart by their first shingles."""
    make = random.Random(9)
    base = " ".join(f"w{make.randrange(10**6)}" for _ in range(400))
    template = " ".join(f"common{i}" for i in range(160))
    contents = [base, base + " more", base + " more words", " ".join(f"x{i}" for i in range(300)), "", "short"]
    contents += [template + "".join(f" own{i}x{j}" for j in range(24)) for i in range(40)]
    prints = [simhash.fingerprint(t.encode(), similar.WORDS) for t in contents]
    assert all(((prints[0] ^ p) % (1 << 64)).bit_count() <= 4 for p in prints[1:3])
    docs = frame(spark, contents)
    named = placed(docs).select(F.struct(F.col("doc_id").alias("id"), F.col("_place").alias("place")).alias("who"), F.col("text").cast("binary").alias("data"))
    real, seen = similar._by_fingerprint, []

    def noted(rows):
        found = real(rows)
        seen.append([{(r.u, r.v) for r in pairs.collect()} for pairs in (found, similar._possible(found, rows))])
        return found

    similar._by_fingerprint = noted
    try:
        out = similar.near_copies(named).filter("who != least").select("who.id", F.col("least.id").alias("least")).collect()
    finally:
        similar._by_fingerprint = real
    nodes = [xxhash.xxh128_digest(similar.shingle_set(t.encode()).tobytes()) for t in contents[:3]]
    (linked, left), = seen
    assert len(linked) > len(left) and {x for pair in left for x in pair} == set(nodes)
    assert {tuple(r) for r in out} == {(1, 0), (2, 0)}


def test_fingerprint():
    for text in ["", "One", "one TWO\tthree\x0bfour five", "é É a b c d e f g"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text.encode(), 4) % (1 << 64) == bits


def test_decontamination_finds_all_with_up_to_two_of_thirteen_changed(spark):
    make = random.Random(8)
    word = lambda: "".join(make.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (40, 15, 13, 9, 5)]
    contents, planted = [], set()
    for i in range(120):
        body, item = [word() for _ in range(make.randint(0, 50))], make.randrange(5)
        part = list(items[item])
        if len(part) >= 13:
            start = make.randint(0, len(part) - 13)
            part = part[start : start + 13]
        allowed = len(part) - -(-len(part) * 4 // 5)
        changes = make.choice([0, allowed, allowed + 1])
        for place in make.sample(range(len(part)), changes):
            part[place] = word()
        if changes <= allowed:
            planted.add((i, item))
        at = make.randint(0, len(body))
        contents.append(", ".join(body[:at] + part + body[at:]).upper())
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    found = decontaminate.overlaps(frame(spark, contents), benchmark).collect()
    assert {(r.id, r.item) for r in found} == planted


def test_few_words_of_a_longer_item_are_no_evidence(spark):
    item = " ".join(f"word{i}" for i in range(20))
    parts = [" ".join(item.split()[3 : 3 + n]) for n in (4, 5, 8, 12, 13, 17)]
    benchmark = spark.createDataFrame([(1, item), (2, "one two three four five six")], "item_id bigint, text string")
    found = decontaminate.overlaps(frame(spark, [*parts, "zero one two three four five six"]), benchmark).collect()
    assert sorted((r.id, r.item, r.equal_words) for r in found) == [(4, 1, 13), (5, 1, 17), (6, 2, 6)]


def test_suffix_array_and_prefixes():
    make = random.Random(2)
    for _ in range(150):
        symbols = make.choice([1, 2, 3, 5])
        text = [make.randint(1, symbols) for _ in range(make.randint(1, 90))] * make.choice([1, 1, 2]) + [0]
        order = sorted(range(len(text)), key=lambda i: text[i:])
        array = sais.suffix_array(np.array(text), symbols + 1)
        assert array.tolist() == order == sais._by_entry(text, symbols + 1)
        before, length = sais.common_prefixes(np.array(text), array)
        for p, q in zip(order, order[1:], strict=False):
            same = 0
            while max(p, q) + same < len(text) and text[p + same] == text[q + same]:
                same += 1
            assert (before[q], length[q]) == (p, same)


@pytest.mark.parametrize("shard_bytes", [suffix.SHARD_BYTES, 1])
def test_repeated_strings(spark, shard_bytes):
    size = 40
    contents = texts(3, 60, words=[f"w{i}é" for i in range(40)])
    passage = " ".join(f"p{i}" for i in range(30))
    contents += [a + passage + b for a, b in zip(contents[:10], contents[10:20], strict=True)] + ["xy" * 60, "z" * 41, contents[0], contents[0], "z" * 39]
    data = [c.encode() for c in contents]
    seen = collections.Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    rows = suffix.remove_repeats(frame(spark, contents), size, shard_bytes=shard_bytes).collect()
    for row in rows:
        text = data[row.id]
        gone = bytearray(len(text))
        for i in range(len(text) - size + 1):
            if seen[text[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        assert row.kept == bytes(b for b, g in zip(text, gone, strict=True) if not g)
        assert sum(s.end - s.start for s in row.spans) == sum(gone)


@pytest.mark.parametrize("least, long_words", [(2, 50), (3, 50), (3, 4), (5, 9), (1, 50)])
def test_repeated_lines(spark, least, long_words):
    make = random.Random(5)
    some = ["ab", "cd ef", "ab", "", "g h\ti j", "k", "ab cd ef gh"]
    contents = ["\n".join(make.choices(some, k=make.randint(0, 25))) for _ in range(40)] + ["a\na\na\na\na\na\na"] * 2
    rows = {r.id: r for r in lines.remove_repeated_lines(frame(spark, contents), least, long_words=long_words).collect()}
    seen = set()
    for i, text in enumerate(contents):
        own = text.split("\n")
        gone = set()
        for k in range(len(own)):
            for n in range(1, least + 1):
                part = tuple(own[k : k + n])
                if len(part) < n or (n < least and sum(len(x.split()) for x in part) < long_words):
                    continue
                if part in seen:
                    gone |= set(range(k, k + n))
                seen.add(part)
        assert rows[i].kept == "\n".join(x for k, x in enumerate(own) if k not in gone)


def test_line_suffixes_are_in_order_with_their_common_prefixes(spark):
    contents = [t.replace(" ", "\n") for t in texts(9, 14, words=("a", "b", "c"), longest=12)] + ["b", "b\na", "b\na\na", "z\nb"]
    numbered = lines.numbered_lines(frame(spark, contents))
    suffix = {r.pos: tuple(contents[r.id].split("\n")[r.line :]) for r in numbered.collect()}
    for depth in (None, 3):
        levels = lines.suffix_ranks(numbered, depth)
        array = sorted((r["rank"], suffix[r.pos]) for r in levels[-1][1].collect())
        assert len(array) == len([s for s in suffix.values() if s[0] != "z"])
        by_rank = collections.defaultdict(set)
        for rank, own in array:
            by_rank[rank].add(own if depth is None else own[:4])
        # A class is one suffix, and a line's order is that of its rank; a suffix that ends comes first.
        assert all(len(own) == 1 for own in by_rank.values())
        first = {r.pos: r["rank"] for r in levels[0][1].collect()}
        order = {suffix[p][0]: rank for p, rank in first.items()}
        keys = [[order.get(x, 1 << 62) for x in next(iter(by_rank[rank]))] for rank in sorted(by_rank)]
        assert keys == sorted(keys)
        common = [r.common for r in lines.common_prefixes(levels, 4).orderBy("rank").collect()]
        plain = [next((n for n, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y))) for x, y in zip(keys, keys[1:], strict=False)]
        assert common[0] == 0 and [min(c, 4) for c in common[1:]] == [min(c, 4) for c in plain]


def test_trust_and_distrust(spark):
    make = random.Random(9)
    edges = list({(f"h{make.randrange(12)}", f"h{make.randrange(12)}"): float(make.randint(1, 5)) for _ in range(40)}.items())
    edges = [(a, b, w) for (a, b), w in edges if a != b]
    seeds = [("trust", "h1", 2.0), ("trust", "h2", 1.0), ("distrust", "h3", 1.0)]
    found = urls.ranks(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "kind string, host string, weight double"))
    for kind in ("trust", "distrust"):
        ways = [(a, b, w) if kind == "trust" else (b, a, w) for a, b, w in edges]
        out = collections.Counter()
        for a, _, w in ways:
            out[a] += w
        own = {h: w for k, h, w in seeds if k == kind}
        start = {h: w / sum(own.values()) for h, w in own.items()}
        rank = dict(start)
        for _ in range(urls.ROUNDS):
            after = collections.Counter({h: 0.15 * w for h, w in start.items()})
            for a, b, w in ways:
                after[b] += 0.85 * rank.get(a, 0) * w / out[a]
            rank = after
        total = sum(rank.values())
        ours = {r.host: r["rank"] for r in found.filter(F.col("kind") == kind).collect()}
        assert all(abs(ours.get(h, 0) - v / total) < 1e-9 for h, v in rank.items())


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    make = random.Random(10)
    assert pii.luhn("4242424242424242") and not pii.luhn("4242424242424241")
    for _ in range(4000):
        text = "".join(make.choice(["@", ".", "a", "b.c", "-", "1", "255", "+1 ", "4242", " ", "(", "é", "0"]) for _ in range(make.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 100_000 + ".2.3.4") == [] and pii.base_spans("a" * 100_000) == []


def test_tagger_slopes_and_learning():
    made = tagger.Tagger(3, seed=1)
    make = np.random.default_rng(0)
    codes = make.integers(97, 123, (2, 6))
    gold = make.integers(0, 3, (2, 6))

    def loss():
        score = made.emissions(codes)
        total = 0.0
        for s, g in zip(score, gold, strict=True):
            paths = np.array(np.meshgrid(*[range(3)] * 6, indexing="ij")).reshape(6, -1).T
            value = lambda p: made.p["first"][p[0]] + sum(s[t, p[t]] for t in range(6)) + sum(made.p["move"][p[t - 1], p[t]] for t in range(1, 6))  # noqa: E731, B023
            total += np.log(sum(np.exp(value(p)) for p in paths)) - value(g)
        return total / 2

    made.p = {k: v.astype(np.float64) for k, v in made.p.items()}
    slopes = made.slopes(codes, gold)
    for name, at in (("out", (3, 1)), ("move", (1, 2)), ("first", (2,)), ("re_f", (2, 5)), ("re_b", (1, 40)), ("in_f", (codes[0, 2], 9)), ("base", (0,))):
        kept = made.p[name][at]
        made.p[name][at] = kept + 1e-3
        up = loss()
        made.p[name][at] = kept - 1e-3
        down = loss()
        made.p[name][at] = kept
        assert abs((up - down) / 2e-3 - slopes[name][at]) < 2e-3


def test_spans_over_window_borders_are_found_whole():
    """A tagger that marks digits as a phone: wherever it stands, one whole span is found."""

    class Digits:
        tags = 9

        def emissions(self, windows):
            out = np.zeros((*windows.shape, 9), np.float32)
            digit = (windows >= 48) & (windows < 58)
            out[..., 0], out[..., 8] = 9 * ~digit, 9 * digit
            return out

        def best_path(self, scores, lengths):
            return np.where(np.arange(scores.shape[1]) < lengths[:, None], scores.argmax(2), 0)

    for place in range(0, 200, 7):
        text = "x" * place + "5" * 90 + "y" * 50
        assert pii.tagged_spans(["", text], Digits()) == [[], [("phone", place, place + 90)]]


def test_toxicity_of_the_held_out_fold(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lexicon = ["idiot", "moron", "loser", "scum", "trash", "stupid", "pathetic", "worthless", "clown", "disgusting"]
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    clear = [r for r in scored if (set(re.findall("[a-z]+", r.text.lower())) & set(lexicon)) or not r.toxic]
    assert sum((r.score >= 0.5) == r.toxic for r in clear) >= 0.97 * len(clear)


def test_toxicity_finds_held_out_toxic_rows_of_every_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("doc_id", "text", "lang", "toxic")
    scored = toxicity.score(held, toxicity.fit(docs, labels)).collect()
    for lang in ("de", "en", "es", "fr"):
        hits = [r.score >= 0.5 for r in scored if r.toxic and r.lang == lang]
        assert sum(hits) >= 0.8 * len(hits) > 4
    clean = [r.score >= 0.5 for r in scored if not r.toxic]
    assert sum(clean) <= 0.02 * len(clean)


def test_batches_between_spark_and_workers_are_small(spark):
    docs = spark.createDataFrame([("x" * 10_000,)] * 2000, "data string").coalesce(1)
    sizes = frames.map_arrow(docs, lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"]) for b in batches), "size bigint").collect()
    assert sum(r["size"] for r in sizes) >= 20_000_000 and max(r["size"] for r in sizes) < 2 * frames.BATCH_BYTES


def test_toxicity_takes_little_memory_at_once(spark, monkeypatch):
    """A worker's arrays take far more than its texts; the limit is for one piece of them."""
    taken = {}
    real = toxicity.map_texts
    monkeypatch.setattr(toxicity, "map_texts", lambda df, column, schema, work, *most: taken.update(work=work, column=column, most=most) or real(df, column, schema, work, *most))
    make = random.Random(4)
    lexicon = ["".join(make.choice("abcdefghij") for _ in range(make.randint(3, 12))) for _ in range(2000)]
    texts = [" ".join(make.choices(lexicon, k=700)) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts[:3]], "text string")
    model = toxicity.Model(np.sort(np.array([toxicity.hash_of(w) for w in lexicon[:300]], np.uint64)), np.zeros(toxicity.BUCKETS + 306), 0.0)
    assert toxicity.score(docs, model).count() == 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([t.encode() for t in texts])], ["text", taken["column"]])
    tracemalloc.start()
    rows = sum(len(taken["work"](piece)[-1]) for piece in frames.pieces(batch, taken["column"], *taken["most"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 48 << 20


def test_toxicity_sample_has_one_row_of_an_identifier(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, toxic int")
    expected = labels.filter(~toxicity.held_out(F.col("doc_id"))).count()
    assert toxicity._sample(docs, labels, 12, 1 << 20).count() == expected > 0
    assert toxicity._sample(docs, labels, 12, 10).count() == 1  # of texts of seven bytes


def test_label_model_discounts_repeated_voters():
    make = np.random.default_rng(5)
    toxic = make.random(2000) < 0.2
    vote = toxic & (make.random(2000) < 0.6)
    other = toxic & (make.random(2000) < 0.6)
    votes = np.stack([vote, vote, vote, other, ~vote & ~other], 1)
    model = toxicity.LabelModel.fit(votes, toxic.astype(int))
    assert model.own[0] < 0.5 < model.own[3]
    assert ((model.posterior(votes) >= 0.5) == (vote | other)).mean() > 0.99


def test_digest_is_the_text(spark):
    row = exact.exact_dedup(frame(spark, ["é"])).first()
    assert row.digest == hashlib.sha256("é".encode()).digest()
