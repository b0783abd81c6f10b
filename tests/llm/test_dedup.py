import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate, fingerprint, line_dedup, ngram_join, substring_dedup

KEY = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))


def made(spark, rows, more=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{more}")


# substring dedup


def repeats(seed):
    r = random.Random(seed)
    parts = [r.choices("abcdefgh", k=60) for _ in range(5)]
    rows = []
    for i in range(90):
        t = []
        for _ in range(r.randrange(5)):
            p, at = r.choice(parts), r.randrange(30)
            t += p[at : at + r.randrange(10, 60)] if r.random() < 0.7 else r.choices("abc", k=r.randrange(1, 60))
        rows.append((i % 80, " \t".join(t)))
    return [*rows, (None, None), (5, None), (None, rows[3][1]), (200, ""), (7, rows[7][1]), (300, "x y " * 4000)]


@pytest.mark.parametrize("seed", [3, 4])
def test_substrings_against_brute_force(spark, seed):
    rows = repeats(seed)
    got = [tuple(r) for r in substring_dedup.digest(made(spark, rows)).collect()]
    assert sorted(got, key=KEY) == sorted(substring_dedup.brute_force(rows), key=KEY)


def test_substrings_carry_no_extra_columns_and_tell_factors(spark):
    words = [f"w{k}" for k in range(90)]
    rows = [(1, " ".join(words)), (2, "a b " + " ".join(words[20:80]) + " c"), (3, " ".join(words[:34])), (None, None)]
    docs = made(spark, rows).selectExpr("*", "1 AS th", "2 AS anchor", "3 AS lo", "text AS context", "4 AS start")
    got = {x["doc_id"]: x for x in substring_dedup.dedup(docs).collect()}
    assert [tuple(f) for f in got[2]["factors"]] == [(2, 60, 1, 20)] and [tuple(f) for f in got[1]["factors"]] == [(20, 60, 2, 2)]
    assert got[2]["kept_text"] == "a b c" and got[3]["n_removed"] == 0 and got[None]["n_words"] == 0


def test_lines_of_one_large_group_of_near_copies(spark):
    """Matches are those of the definition, and no join returns more rows than it has postings."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(40)]
    lines = []
    for i in range(900):
        x = list(base)
        for k in r.sample(range(40), r.randrange(7)):
            x[k] = f"v{i}x{k}" if r.random() < 0.7 else f"u{k}"
        lines.append(" ".join(x))
    rows = [(i, line) for i, line in enumerate(lines)]
    got = line_dedup.dedup_lines(made(spark, rows)).collect()
    assert sorted([(x["doc_id"], x["text"], x["lines_removed"]) for x in got], key=KEY) == sorted(plain_lines(rows), key=KEY)


def test_substrings_of_nothing(spark):
    assert substring_dedup.digest(made(spark, [])).count() == 0


# line dedup


def line_rows(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    lines = [" ".join(r.choices(words, k=r.randrange(1, 14))) for _ in range(40)]
    out = []
    for i in range(40):
        own = []
        for _ in range(r.randrange(1, 6)):
            x = r.choice(lines).split(" ")
            if r.random() < 0.5:
                x[r.randrange(len(x))] = r.choice(words)
            own.append(" ".join(x))
        out.append((i * 3 % 37, "\n".join(own)))
    return out


def plain_lines(rows):
    """Judged line by line on the definition."""
    place, sets = {}, {}
    for k, t in rows:
        for n, line in enumerate(t.split("\n") if t else []):
            s = frozenset(line.split(" ")) - {""}
            at = (-(2**63) if k is None else k, t, n)
            if s:
                place.setdefault(line, []).append((at[0], n))
                sets[line] = s
    first = {line: min(p) for line, p in place.items()}
    bad = {b for a in sets for b in sets if a != b and first[a] < first[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    out = []
    for k, t in rows:
        if not t:
            out.append((k, t, 0))
            continue
        own = t.split("\n")
        stay = [x for n, x in enumerate(own) if not x.replace(" ", "") or (first[x] == (-(2**63) if k is None else k, n) and x not in bad)]
        out.append((k, "\n".join(stay), len(own) - len(stay)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_the_definition(spark, seed, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 12)  # so that both kinds of keys are used
    rows = {k: (k, t) for k, t in line_rows(seed)}
    rows = [*rows.values(), (500, None), (501, ""), (502, "\n \n"), (None, "a b c d e\nunique line here")]
    got = line_dedup.dedup_lines(made(spark, [(*r, 1) for r in rows], ", th int")).collect()
    assert sorted([(r["doc_id"], r["text"], r["lines_removed"]) for r in got], key=KEY) == sorted(plain_lines(rows), key=KEY)
    assert {r["th"] for r in got} == {1}


@pytest.mark.parametrize("sample", [1, 9])
def test_lines_by_an_order_from_few_documents(spark, sample, monkeypatch):
    """The result is that of the definition, whatever the order of rarity has been counted on; few documents are."""
    monkeypatch.setattr(line_dedup, "HOT", 12)
    monkeypatch.setattr(line_dedup, "SAMPLE", sample)
    rows = list({k: (k, t) for k, t in line_rows(6)}.values())
    docs = made(spark, rows)
    got = line_dedup.dedup_lines(docs).collect()
    assert sorted([(r["doc_id"], r["text"], r["lines_removed"]) for r in got], key=KEY) == sorted(plain_lines(rows), key=KEY)
    many = docs.withColumn("th", F.xxhash64("text"))
    tables = [line_dedup.rarity(many, n).split("'")[1].split(",") for n in (len(rows), 1)]
    few, whole = (sum(c != "0" for c in t) for t in tables)
    assert few < whole


def test_postings_are_compared_without_null_checks(spark, monkeypatch, tmp_path):
    """Token ids and written postings can't be null by type; hot tokens come with each later one of the prefix; both sides of the join read one shuffle."""
    lines = ["b a  a c hot", "hot", " ", "x hot b hot", "hot hotter"]
    classes = "array_repeat(cast(0 as tinyint), 262144)"
    monkeypatch.setattr(line_dedup, "HOT", 2)
    ids = made(spark, list(enumerate(lines))).selectExpr("doc_id", "text", f"{line_dedup.token_ids('text', classes)} AS ids")
    assert not ids.schema["ids"].dataType.containsNull
    assert {r["doc_id"]: len(r["ids"]) for r in ids.collect()} == {i: len(set(t.split())) for i, t in enumerate(lines)}
    assert all(r["ids"] == sorted(r["ids"]) for r in ids.collect())
    hot = line_dedup._class(2) << 56
    rows = [(1, 3, 0, 0, [5, hot + 1, hot + 2, hot + 3]), (2, 1, 0, 0, [hot + 1]), (None, 9, 0, 0, [5, 6, 7])]
    sets = spark.createDataFrame(rows, "h long, n int, b0 long, b1 long, prefix array<long>")
    got = line_dedup.postings(sets)
    assert not any(f.nullable for f in got.schema)
    pair = lambda *k: sets.selectExpr(f"xxhash64({k[0]}L, {k[1]}L)").first()[0]
    want = [(1, 0, 5), (1, 1, pair(hot + 1, hot + 2)), (1, 1, pair(hot + 1, hot + 3)), (1, 2, pair(hot + 2, hot + 3)), (2, 0, hot + 1), (0, 0, 5), (0, 1, 6)]
    assert sorted((r["h"], r["i"], r["key"]) for r in got.collect()) == sorted(want)
    monkeypatch.setattr(line_dedup, "HOT", 12)
    sets.write.mode("overwrite").parquet(f"{tmp_path}/sets")
    maybe = line_dedup.candidates(spark.read.parquet(f"{tmp_path}/sets"))
    assert maybe.collect() == [] and "ReusedExchange" in maybe._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_hashed_once_and_verified_by_four_bitmaps(spark):
    """A lambda hashes each token once; the quarters part all hashes; the bound by four bitmaps turns no match down, and spares most others."""
    assert line_dedup.token_ids("text", "c").count("xxhash64(t)") == 1 and "t -> xxhash64(t)" in line_dedup.token_ids("text", "c")
    edges = [-(2**63), -(2**62) - 1, -(2**62), -1, 0, 2**62 - 1, 2**62, 2**63 - 1]
    hashes = spark.createDataFrame([(x,) for x in edges], "x long")
    assert all(sum(r) == 1 for r in hashes.selectExpr(*[f"int({q})" for q in line_dedup.QUARTERS]).collect())
    r = random.Random(11)
    base, texts = [f"w{k}" for k in range(60)], []
    for i in range(40):
        n = r.randrange(1, 60)
        texts += [" ".join(base[:n]), " ".join(base[: n - n // 10] + [f"v{i}x{k}" for k in range(r.randrange(1 + n // 10))])]
    docs = made(spark, list(enumerate(texts))).withColumn("th", F.xxhash64("text"))
    wanted = line_dedup.lines_of(docs).select("h").distinct()
    whole = line_dedup.whole_sets(docs, wanted)
    assert len(whole._jdf.queryExecution().optimizedPlan().toString()) < 2 * line_dedup.BUCKETS  # it holds no rarity table
    sets = whole.select("h", "hashes", F.size("hashes").alias("n"), *line_dedup.bitmaps("hashes", range(2)), "b2", "b3").cache()
    pairs = sets.alias("a").join(sets.alias("b"), F.expr("a.h < b.h"))
    got = pairs.selectExpr("9 * size(array_intersect(a.hashes, b.hashes)) >= 4 * (a.n + b.n) AS match", f"{line_dedup.STILL_MAY} AS may").groupBy("match", "may").count().collect()
    count = {(x["match"], x["may"]): x["count"] for x in got}
    assert count[True, True] > 40 and (True, False) not in count and count[False, False] > 2 * count[False, True]


def test_lines_of_repeated_rows_and_of_nothing(spark):
    got = line_dedup.dedup_lines(made(spark, [(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "a b c")])).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == {(1, "a b c\nd e f"): 2, (2, ""): 1}
    assert line_dedup.dedup_lines(made(spark, [])).count() == 0


# decontamination


def test_overlaps_of_odd_rows(spark):
    item = " ".join(f"b{k}" for k in range(20))
    rows = [(1, item), (1, item), (None, item), (2, "clean text of some words"), (2, item + " more"), (3, None)]
    docs = made(spark, rows).selectExpr("*", "7 AS item_id", "8 AS same", "text AS h")
    bench = spark.createDataFrame([(5, item), (5, item), (6, None)], "item_id long, text string").withColumn("doc_id", F.lit(9))
    assert {x["doc_id"] for x in decontaminate.overlaps(docs, bench).collect()} == {1, None, 2}
    kept = decontaminate.clean(docs, bench)
    assert sorted(kept.columns) == sorted(docs.columns) and {x["doc_id"] for x in kept.collect()} <= {2, 3}


def test_overlaps_with_substitutions(spark):
    r = random.Random(2)
    words = [f"t{i}" for i in range(500)]
    items = [(i, " ".join(r.choices(words, k=30))) for i in range(6)] + [(90, None), (91, "too short")]
    rows, leaked = [], set()
    for i in range(60):
        body = r.choices(words, k=80)
        if i % 3 == 0:
            passage = items[i % 6][1].split()
            for at in range(r.randrange(10), 30, 10):  # every tenth word is another
                passage[at] = "other"
            body[40:40] = passage
            leaked.add(i)
        rows.append((i, ", ".join(body).upper() if i % 2 else " ".join(body)))
    rows += [(None, items[0][1]), (70, None), (71, "")]
    docs, bench = made(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = {x["doc_id"] for x in decontaminate.overlaps(docs, bench).collect()}
    assert found == leaked | {None}
    assert {x["doc_id"] for x in decontaminate.clean(docs, bench).collect()} == {k for k, _ in rows} - leaked - {None}
    assert decontaminate.overlaps(docs.limit(0), bench).count() == decontaminate.overlaps(docs, bench.limit(0)).count() == 0


# n-gram join


def copies(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(800)]
    common = r.choices(words, k=14)
    docs = []
    for b in range(40):
        base = r.choices(words, k=r.randrange(60, 150))
        for _ in range(r.choice([1, 1, 2, 3, 9]) if b else 330):
            x = list(base)
            for _ in range(r.randrange(4)):
                x[r.randrange(len(x))] = r.choice(words)
            docs.append(" ".join(x + common if r.random() < 0.5 else x))
    docs += ["", None, "a", "a b", "a b c d e", docs[5], docs[5]]
    r.shuffle(docs)
    return list(enumerate(docs))


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 60)
    monkeypatch.setattr(ngram_join, "TILE", 128)
    rows = copies(5)
    sets = defaultdict(list)
    for k, t in rows:
        sets[ngram_join.grams(t, {}).tobytes()].append(k)
    classes = [(min(v), set(np.frombuffer(k, np.uint64).tolist())) for k, v in sets.items()]
    links = Counter()
    for i, (a, x) in enumerate(classes):
        for b, y in classes[:i]:
            n = len(x & y)
            if n and n >= 0.8 * (len(x) + len(y) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
    assert sum(links.values()) > 5_000
    home = {k: min(v) for v in sets.values() for k in v}
    got = ngram_join.report(made(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["links"]) for r in got) == sorted((k, home[k], links[home[k]]) for k, _ in rows)
    kept = ngram_join.dedup(made(spark, rows))
    worded = {r["group_id"] for r in got if (dict(rows)[r["doc_id"]] or "").split()}
    assert kept.where("text != ''").count() == len(worded)


def test_planted_links_are_found(spark):
    """Pairs that stand alone, of similarities from 0.8 to 0.95: nothing but a shared path ties them."""
    r = random.Random(12)
    rows, want = [], set()
    for i in range(240):
        base = [f"w{i}x{k}" for k in range(120)]
        other = base[: -r.randrange(1, 23)]  # a shorter text: its grams are a part of the longer one's
        a, b = (set(zip(*(x[k:] for k in range(5)))) for x in (base, other))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        if len(b) >= 0.8 * len(a):
            want.add(i)
    got = {x["doc_id"]: x["links"] for x in ngram_join.report(made(spark, rows)).collect()}
    found = {i for i in range(240) if got[2 * i] == got[2 * i + 1] == 1}
    assert found <= want and len(want) > 150 and len(found) >= 0.9 * len(want)


def test_buckets_that_nothing_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    monkeypatch.setattr(ngram_join, "MAX_DEPTH", 1)
    monkeypatch.setattr(ngram_join, "SAME", 99)  # no class is done by its pivot
    r = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(base[: 100 - i % 9] + [f"own{i}"])) for i in range(60)]
    got = ngram_join.report(made(spark, rows)).collect()
    assert {x["group_id"] for x in got} == {0} and all(x["links"] == 59 for x in got)


def test_join_of_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text + " eight"), (None, None), (3, text), (3, text), (3, "another text altogether here it is")]
    docs = made(spark, rows).selectExpr("*", "1 AS class", "2 AS th", "text AS signature", "3 AS links")
    got = ngram_join.report(docs).collect()
    assert len(got) == 6 and Counter(x["doc_id"] for x in got) == Counter(k for k, _ in rows)
    kept = ngram_join.dedup(docs)
    assert sorted(kept.columns) == sorted(docs.columns) and (3, text) in {(x["doc_id"], x["text"]) for x in kept.collect()}


def test_join_of_nothing(spark):
    assert ngram_join.report(made(spark, [])).count() == 0


# fingerprints


def test_fingerprints_recover_differences(spark):
    r = random.Random(4)
    sentence = lambda: " ".join("".join(r.choices("abcdefg", k=5)) for _ in range(12)) + "."
    rows = [(i * 7, "\n".join(sentence() for _ in range(r.choice([0, 1, 3, 8, 40, 200])))) for i in range(25)]
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (None, "alone. " * 40)]
    got = {x["doc_id"]: x for x in fingerprint.fingerprints(made(spark, rows)).collect()}
    import re

    cut = lambda t: set(re.findall(rf"[^\n]{{{fingerprint.PIECE},}}?[.!?](?=\s)|[^\n]+", t))
    like = lambda a, b: 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))
    order = sorted((k, t or "") for k, t in rows if k is not None)
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[k]["n_chars"] == len(t)
        assert got[k]["near_edited"] == pytest.approx(like(cut(t), cut(edited)))
        assert got[k]["near_next"] == pytest.approx(like(cut(t), cut(after)))
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[1002]["fingerprint"] == got[rows[3][0]]["fingerprint"]
    assert got[None]["n_chars"] == 280 and got[None]["near_next"] == 0.0
    assert fingerprint.fingerprints(made(spark, [])).count() == 0


def test_fingerprints_are_compared_by_themselves(spark):
    """Likeness of two strings: of any sizes, each function of its own text; the edited text has the fingerprint of a document that holds it."""
    r = random.Random(9)
    sets = [set(r.sample(range(-(2**60), 2**60), n)) for n in (0, 1, 5, 9, 30, 130, 700)]
    sets += [set(list(s)[: len(s) // 2]) | {r.getrandbits(50)} for s in sets]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "i int, keys array<bigint>").selectExpr("i", f"{fingerprint.sketch('keys')} AS sketch").selectExpr("i", f"{fingerprint.printed('sketch')} AS print").cache()
    prints = dict(df.collect())
    both = spark.createDataFrame([(i, j, prints[i], prints[j]) for i in range(len(sets)) for j in range(len(sets))], "i int, j int, x string, y string")
    both = both.selectExpr("i", "j", f"{fingerprint.parsed('x')} AS a", f"{fingerprint.parsed('y')} AS b").selectExpr("i", "j", f"{fingerprint.aligned('a', 'b')} AS pair").selectExpr("i", "j", f"{fingerprint.likeness('pair')} AS near")
    for i, j, near in both.collect():
        a, b = sets[i], sets[j]
        assert near == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0)


def test_fingerprints_of_odd_rows(spark):
    least = -(2**63)
    rows = [(least, "First. " * 30, "x"), (7, "second line\nthird", "y"), (7, "other text", "z"), (7, "other text", "z"), (None, None, None), (None, "n", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").selectExpr("*", "text AS `key`", "doc_id AS near_next", "1 AS lent")
    got = fingerprint.fingerprints(docs).collect()
    assert Counter(x["doc_id"] for x in got) == Counter(x[0] for x in rows)
    at = {(x["doc_id"], x["n_chars"]): x for x in got}
    edited = rows[0][1][:105] + "other text"  # the least leading part of the two texts under 7
    assert at[least, 210]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    again = fingerprint.fingerprints(made(spark, [(1, edited)])).first()
    assert at[least, 210]["edited_fingerprint"] == again["fingerprint"]
    # a single document is followed by itself
    assert again["near_next"] == 1.0 and again["edited_sha256"] == hashlib.sha256((edited[:58] + edited[:57]).encode()).hexdigest()


def test_components(spark):
    r = random.Random(8)
    edges = [(bytes([i // 256, i % 256]), bytes([j // 256, j % 256])) for i, j in [(k, k + 1) for k in range(300, 340)] + [(r.randrange(250), r.randrange(250)) for _ in range(150)]]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {bytes(x["class"]): bytes(x["group"]) for x in ngram_join.groups(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert ngram_join.groups(spark.createDataFrame([], "a binary, b binary")).count() == 0
