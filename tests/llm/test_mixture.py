import random
import time

import pytest

from marginalia.llm import mixture as mx
from marginalia.llm.mixture import mix_sources, route


def test_route_meets_shares_within_repeats():
    flow, total = route([(("a",), 1000), (("a", "b"), 500), (("b",), 100)], {"a": 0.5, "b": 0.5, "none": 0.1}, {"a": 1, "b": 3, "none": 2})
    a = sum(n for (_, s), n in flow.items() if s == "a")
    b = sum(n for (_, s), n in flow.items() if s == "b")
    assert abs(a - b) <= 1 and a + b >= total - 2 and flow.get((2, "b"), 0) <= 300 and total in (3000, 3001)


def test_repetition_is_spread_before_it_grows():
    flow, _ = route([(("a",), 100), (("a", "b"), 100)], {"a": 0.5, "b": 0.5}, {"a": 5, "b": 5}, total=200)
    assert flow == {(0, "a"): 100, (1, "b"): 100}


def test_largest_total_is_found_by_brute_force():
    rng = random.Random(1)
    for _ in range(20):
        patterns = [(("a",), rng.randint(1, 9)), (("b",), rng.randint(1, 9)), (("a", "b"), rng.randint(1, 9))]
        repeats = {"a": rng.randint(1, 3), "b": rng.randint(1, 3)}
        _, total = route(patterns, {"a": 0.25, "b": 0.75}, repeats)
        cap_a = (patterns[0][1] + patterns[2][1]) * repeats["a"]
        cap_b = (patterns[1][1] + patterns[2][1]) * repeats["b"]
        assert total == max(t for t in range(400) if int(t * 0.25) <= cap_a and int(t * 0.75) <= cap_b)


def cheapest_by_units(patterns, quotas, repeats):
    """Least cost of the quotas: one token after the other along a cheapest path (Bellman-Ford)."""
    x = {(i, s): 0 for i, (sources, _) in enumerate(patterns) for s in sources}
    cost = 0
    for target, wanted in quotas.items():
        for _ in range(wanted):
            used = [sum(x[i, s] for s in sources) for i, (sources, _) in enumerate(patterns)]
            dist = {}
            for i, (sources, n) in enumerate(patterns):
                for s in sources:
                    if x[i, s] < n * repeats[s]:
                        dist[s] = min(dist.get(s, (1 << 30, None)), ((used[i] // n) ** 2, [(i, s)]))
            for _ in repeats:
                for (i, s), v in x.items():
                    for t in patterns[i][0]:
                        if v and s in dist and x[i, t] < patterns[i][1] * repeats[t] and dist[s][0] < dist.get(t, (1 << 30,))[0]:
                            dist[t] = (dist[s][0], [*dist[s][1], (i, s, t)])
            price, steps = dist[target]
            cost += price
            for step in steps:
                if len(step) == 2:
                    x[step] += 1
                else:
                    x[step[0], step[1]] -= 1
                    x[step[0], step[2]] += 1
    return cost


def test_flow_is_of_least_cost():
    rng = random.Random(5)
    for _ in range(60):
        names = "abcd"[: rng.randint(1, 4)]
        patterns = [(tuple(sorted(rng.sample(names, rng.randint(1, len(names))))), rng.randint(1, 7)) for _ in range(rng.randint(1, 6))]
        repeats = {s: rng.randint(1, 4) for s in names}
        shares = {s: rng.choice((0.1, 0.2, 0.5)) for s in names}
        flow, total = route(patterns, shares, repeats)
        held = {s for s in names if any(s in p for p, _ in patterns)}
        quotas = {s: int(total * shares[s] / sum(shares[t] for t in sorted(held))) for s in sorted(held)}
        assert {s: sum(n for (_, t), n in flow.items() if t == s) for s in held} == quotas
        assert all(n <= patterns[i][1] * repeats[s] and s in patterns[i][0] for (i, s), n in flow.items())
        used = [sum(n for (j, _), n in flow.items() if j == i) for i in range(len(patterns))]
        own = sum(sum((k // n) ** 2 for k in range(u)) for u, (_, n) in zip(used, patterns))
        assert own == cheapest_by_units(patterns, quotas, repeats)


def test_many_patterns_and_sources_take_little_time():
    rng = random.Random(3)
    names = [f"s{i}" for i in range(100)]
    patterns = sorted({tuple(sorted(rng.sample(names, min(100, 1 + int(rng.expovariate(0.4)))))) for _ in range(8000)})
    patterns = [(p, rng.randint(100, 100_000)) for p in patterns]
    assert len(patterns) > 5000
    began = time.perf_counter()
    flow, total = route(patterns, {n: rng.random() ** 2 + 0.01 for n in names}, {n: rng.randint(1, 8) for n in names})
    assert time.perf_counter() - began < 60 and total > 0 and sum(flow.values()) > total - 101
    with pytest.raises(ValueError):
        route([((n,), 1) for n in names] * (mx.MOST_CELLS // 100 + 1), dict.fromkeys(names, 0.1), dict.fromkeys(names, 1))


def test_every_document_may_be_used_as_often_as_its_source_allows(spark):
    rows = [(1, "a", "same words here"), (2, "a", "same words here"), (2, "a", "same words here"), (None, "a", "same words here"), (4, "b", "same words here"), (5, "b", "other words there too")]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 9)], "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), targets)
    got = {(r.source, r.doc_id): r.n_repeats for r in mixture.collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == {("a", 1): 2, ("a", 2): 2, ("a", None): 2}
    assert all(abs(r.reached_share - 0.5) < 0.15 for r in report.collect())


def docs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), " ".join(rng.choice(["cell", "gene", "map", "x"]) + str(rng.randrange(1000)) for _ in range(rng.randint(3, 12)))) for i in range(400)]
    rows += [(1000 + i, "c", rows[i][2]) for i in range(60)] + [(2000, "a", None), (2001, "a", ""), (2002, None, "lost"), (2003, "unlisted", "lost"), (2004, "a", rows[0][2])]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_mixture_over_tables(spark):
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 8), ("empty", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(docs(spark), targets, seed=3)
    rows = {r.source: r for r in report.collect()}
    for s, share in (("a", 0.4), ("b", 0.3), ("c", 0.2)):
        assert abs(rows[s].reached_share - share / 0.9) < 0.03 and rows[s].most_repeats <= {"a": 1, "b": 2, "c": 8}[s]
    assert rows["empty"].reached_share == 0.0
    picked = mixture.collect()
    assert len({(r.source, r.doc_id) for r in picked}) == len(picked) and not {r.doc_id for r in picked} & {2000, 2001, 2002, 2003}
    assert picked == mix_sources(docs(spark), targets, seed=3)[0].collect() or sorted(picked) == sorted(mix_sources(docs(spark), targets, seed=3)[0].collect())


def test_empty_inputs_and_extra_columns(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    d = docs(spark)
    mixture, report = mix_sources(d.limit(0), targets)
    assert mixture.collect() == [] and [r.tokens for r in report.collect()] == [0]
    mixture, report = mix_sources(d, targets.limit(0))
    assert mixture.collect() == [] and report.collect() == []
    extra = d.withColumn("key", d["doc_id"]).withColumn("pattern", d["source"]).withColumn("n_tokens", d["doc_id"])
    assert mix_sources(extra, targets)[0].count() > 0
