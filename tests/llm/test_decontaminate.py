import random

from skein.llm import decontaminate


def _brute(docs, items):
    """Every overlap by trying all diagonals, without seeds."""
    found = {}
    for d, have in docs:
        for b, want in items:
            region = min(len(want), decontaminate.REGION)
            for shift in range(-len(want), len(have) + 1):
                equal = [0 <= j + shift < len(have) and have[j + shift] == w for j, w in enumerate(want)]
                best = max(sum(equal[s : s + region]) for s in range(len(want) - region + 1))
                if best >= decontaminate.SHARE * region - 1e-9:
                    found[d, b] = max(found.get((d, b), 0), sum(equal))
    return found


def test_every_overlap_is_found(spark):
    rnd = random.Random(4)
    fresh = iter(f"w{n}" for n in range(10**6))
    take = lambda n: [next(fresh) for _ in range(n)]
    items = [(n, take(n)) for n in [*range(1, 21), 40]]
    docs = []
    for b, want in items:
        for k in range(24):
            part = list(want)
            for j in rnd.sample(range(len(part)), min(len(part), k % 5)):
                part[j] = next(fresh)
            docs.append((len(docs), take(rnd.randrange(4)) + part[: 15 if k % 2 else None] + take(rnd.randrange(4))))
    # an exact copy of 12 tokens at an odd place, and single words of an item that are no overlap
    docs += [(len(docs), take(1) + items[11][1] + take(5)), (len(docs) + 1, items[20][1][:11] + take(30))]
    want = _brute(docs, items)
    assert len(want) > 200
    text = lambda rows, name: spark.createDataFrame([(n, " ".join(t)) for n, t in rows], f"{name} long, text string")
    got = decontaminate.overlaps(text(docs, "doc_id"), text(items, "item_id"))
    assert {(r.doc_id, r.item_id): r.same for r in got.collect()} == want


def test_masks_lose_nothing():
    """Whichever places differ, hits are left; masks leave places out."""
    assert all(decontaminate.kept_hits(n) > 0 for n in range(1, 40))
    assert all(set(m) != set(range(m[-1] + 1)) for m in (*decontaminate.LONG, *decontaminate.SHORT))


def test_substitutions_at_random(spark):
    """Overlaps of 15, 20 and 30 tokens, a tenth or a fifth of them exchanged: all that the rule takes are found, and those are nine in ten at a tenth."""
    rnd = random.Random(7)
    items = [(k, [f"i{k}x{j}" for j in range(n)]) for k, n in enumerate((15, 20, 30))]
    docs, plan = [], []
    for share in (0.1, 0.2):
        for k, (_, want) in enumerate(items):
            for _ in range(60):
                part = [f"s{len(docs)}y{j}" if rnd.random() < share else w for j, w in enumerate(want)]
                docs.append((len(docs), [f"a{len(docs)}"] * rnd.randrange(3) + part + ["z"]))
                plan.append((share, k))
    want = _brute(docs, items)
    text = lambda rows, name: spark.createDataFrame([(n, " ".join(t)) for n, t in rows], f"{name} long, text string")
    got = decontaminate.overlaps(text(docs, "doc_id"), text(items, "item_id"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == set(want)
    assert sum((i, k) in found for i, (share, k) in enumerate(plan) if share == 0.1) >= 0.9 * 180
