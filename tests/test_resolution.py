"""Resolution of calls and imports against plain Python, and after changes against resolving all anew."""

import random

import pytest

from sparkloom.operators import resolution as r


def plain(calls, symbols, imports):
    out = set()
    for src, file, name in set(calls):
        own = {s for n, f, s in symbols if n == name and f == file}
        near = {s for n, f, s in symbols if n == name and (file, f) in imports}
        every = {x for x in symbols if x[0] == name}
        found, c = (own, 0.95) if own else (near, 0.8) if near else ({s for _, _, s in every}, 0.3) if len(every) == 1 else ({f"callee:{name}"}, 0.2)
        out |= {(src, file, name, dst, c) for dst in found}
    return out


def some_state(rng, files):
    names = "abcdefgh"
    calls = {(f"{f}:{k}", f, rng.choice(names)) for f in files for k in range(rng.randrange(4))}
    symbols = {(n, f, f"{f}::{n}{k}") for f in files for n in rng.sample(names, rng.randrange(3)) for k in range(rng.choice([1, 1, 2]))}
    return calls, symbols, {(f, g) for f in files for g in rng.sample(files, 2) if f != g}


def frames(spark, calls, symbols, imports):
    return (
        spark.createDataFrame(sorted(calls) * 2, "src string, file string, name string"), spark.createDataFrame(sorted(symbols), "name string, file string, symbol string"),
        spark.createDataFrame(sorted(imports), "file string, imported string"),
    )


@pytest.mark.parametrize("seed", range(4))
def test_calls(spark, seed):
    rng = random.Random(seed)
    files = [f"f{k}" for k in range(8)]
    old = some_state(rng, files)
    fresh = some_state(rng, files)
    changed = set(rng.sample(files, 2))
    # the changed files as in the fresh state, one of them gone, all others as they were
    gone = sorted(changed)[0]
    new = tuple({x for x in a if x[at] not in changed} | {x for x in b if x[at] in changed - {gone}} for a, b, at in zip(old, fresh, (1, 1, 0), strict=True))
    before, after = frames(spark, *old), frames(spark, *new)
    assert {tuple(x) for x in r.call_targets(*before).collect()} == plain(*old)
    files_df = spark.createDataFrame([(f,) for f in changed], "file string")
    got = r.re_resolve_calls(r.call_targets(*before), after[0], before[1], after[1], before[2], after[2], files_df).collect()
    assert {tuple(x) for x in got} == plain(*new) and len(got) == len(plain(*new))


def test_a_hot_name_stays_where_it_is(spark):
    calls = [(f"x{k}", f"g{k}", "get") for k in range(200)]
    symbols = [("get", f"d{k}", f"d{k}::get") for k in range(50)]
    more = [*symbols, ("get", "d50", "d50::get")]
    c, s, i = frames(spark, set(calls), set(symbols), {("g1", "d50"), ("g2", "d1")})
    new = spark.createDataFrame(more, "name string, file string, symbol string")
    again = {x["src"] for x in r.affected_calls(c, s, new, i, i, spark.createDataFrame([("d50",)], "file string")).collect()}
    assert again == {"x1"}


def test_imports(spark):
    wanted = spark.createDataFrame([("a", "k1"), ("a", "k2"), ("b", "k3"), ("b", "k4"), ("c", "k1")], "src string, key string")
    old = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k2", "p3"), *[("k4", f"q{n}") for n in range(8)]], "key string, dst string")
    new = spark.createDataFrame([("k1", "p1"), ("k1", "p9"), ("k3", "p4"), *[("k4", f"q{n}") for n in range(9)]], "key string, dst string")
    before = r.import_targets(wanted, old)
    assert {tuple(x) for x in before.where("key <> 'k4'").collect()} == {("a", "k1", "p1", 1.0), ("c", "k1", "p1", 1.0), ("a", "k2", "p2", 0.6), ("a", "k2", "p3", 0.6), ("b", "k3", "external:k3", 0.2)}
    got = r.re_resolve_imports(before, wanted, old, new, wanted.select("src").limit(0))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, r.import_targets(wanted, new).collect())) and got.where("key = 'k4'").first()["dst"] == "external:k4"


def test_targets_are_found_once_a_place_and_packed_for_each_call(spark, monkeypatch):
    kept = {}
    real = r.stage

    def staged(df, name):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(r, "stage", staged)
    calls = spark.createDataFrame([(f"o{k}", "a", "f") for k in range(50)] + [("o1", "a", "g"), ("o1", "b", "g"), ("o2", "b", "h"), ("o3", "b", "i"), ("o3", "b", "i")], "src string, file string, name string")
    symbols = spark.createDataFrame([("f", "s", "s::1"), ("f", "s", "s::2"), ("f", "t", "t::1"), ("g", "a", "a::9"), ("g", "s", "s::9"), ("h", "z", "z::1")], "name string, file string, symbol string")
    imports = spark.createDataFrame([("a", "s"), ("a", "t"), ("a", "none")], "file string, imported string")
    packed = {(x["src"], x["file"], x["name"]): (sorted(x["dsts"]), x["confidence"]) for x in r._packed_targets(calls, symbols, imports).collect()}
    assert kept["places"].count() == 5
    assert packed == {("o%d" % k, "a", "f"): (["s::1", "s::2", "t::1"], 0.8) for k in range(50)} | {
        ("o1", "a", "g"): (["a::9"], 0.95), ("o1", "b", "g"): (["callee:g"], 0.2), ("o2", "b", "h"): (["z::1"], 0.3), ("o3", "b", "i"): (["callee:i"], 0.2)
    }


def planned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_targets_stay_with_their_file(spark):
    rng = random.Random(7)
    files = [f"f{k}" for k in range(8)]
    state = some_state(rng, files)
    frame = frames(spark, *state)
    resolved = r.resolve_calls(*frame)
    # no target is dealt out by its caller, nor what is kept by anything but its file
    assert "hashpartitioning(src" not in planned(resolved)
    assert {tuple(x) for x in resolved.collect()} == {(src, dst, c) for src, _, _, dst, c in plain(*state)}
    again = r.re_resolve_calls(r.call_targets(*frame), *frame[:1], *frame[1:2] * 2, *frame[2:] * 2, spark.createDataFrame([("f1",)], "file string"))
    assert "hashpartitioning(src" not in planned(again)
    assert {tuple(x) for x in again.collect()} == plain(*state)


def test_callers_in_several_files_odd_names_and_nulls(spark):
    calls = [("x", "a", "f"), ("x", "b", "f"), ("y", "a", "f"), ("x", "b", "g"), (None, "a", "f"), (None, "b", "f"), ("z", None, "one"), ("z", "c", None), ("z", "d", "one")]
    symbols = [("f", "a", "s\n1"), ("f", "s", "s\\n1"), ("f", "s", "s\\b\n"), ("f", "t", ""), ("g", "b", "s\n1"), ("one", "z", "z::\\")]
    c = spark.createDataFrame(calls * 2, "src string, file string, name string")
    s = spark.createDataFrame(symbols, "name string, file string, symbol string")
    i = spark.createDataFrame([("b", "s"), ("b", "t"), ("b", "b"), ("a", "t"), (None, "a")], "file string, imported string")
    got = sorted(map(str, r.resolve_calls(c, s, i).collect()))
    near = ["s\\n1", "s\\b\n", ""]
    want = {(src, "s\n1", 0.95) for src in ("x", "y", None)} | {(src, x, 0.8) for src in ("x", None) for x in near} | {("z", "z::\\", 0.3), ("z", None, 0.2)}
    assert got == sorted(str(x) for x in spark.createDataFrame(sorted(want, key=str), "src string, dst string, confidence double").collect())
    # brought up from nothing, rows without a file among them
    none = (c.limit(0), s.limit(0), i.limit(0))
    changed = c.select("file").unionByName(s.select("file"))
    again = r.re_resolve_calls(r.call_targets(c.where("file IS NULL"), s.limit(0), i.limit(0)), c, none[1], s, none[2], i, changed)
    assert sorted(map(str, again.collect())) == sorted(map(str, r.call_targets(c, s, i).collect()))
