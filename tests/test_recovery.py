"""Recovery of staged inputs and quarantine of half-done output, against a plain walk over the same names."""

import random

from pyspark.sql import functions as F

from libraryloom.operators import recovery

UUID = "123e4567-e89b-12d3-a456-4266141740"


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_recovered(spark):
    staged = [f"{UUID}01-a.pdf", f"{UUID}00-a.pdf", f"{UUID}02-b", f"{UUID}03_c.pdf", f"{UUID.upper()}04-d.pdf", "stray.txt", f"{UUID}05-", f"{UUID}06-n.1.tar.gz", "", None]
    rows = {r.staged: (r.action, r.target) for r in recovery.recovered(_names(spark, staged), _names(spark, ["a.1.pdf", "b", "n.1.tar.gz"])).collect()}
    assert rows == {
        f"{UUID}00-a.pdf": ("return", "a.pdf"), f"{UUID}01-a.pdf": ("return", "a.2.pdf"), f"{UUID}02-b": ("return", "b.1"), f"{UUID}05-": ("return", ".1"),
        f"{UUID}06-n.1.tar.gz": ("return", "n.1.tar.1.gz"), f"{UUID}03_c.pdf": ("remove", None), f"{UUID.upper()}04-d.pdf": ("remove", None), "stray.txt": ("remove", None), "": ("remove", None),
    }
    assert recovery.recovered(_names(spark, []), _names(spark, ["a"])).count() == 0


def _files(spark, rows):
    return spark.createDataFrame(rows, "rel_path string, at long").select("rel_path", F.timestamp_seconds("at").alias("modified"))


def _plain(before, after, started, taken):
    """One folder after the other, in order, as they would be moved by hand."""
    known = {p.rsplit("/", k)[0] for p, _ in before for k in range(1, p.count("/") + 1)}
    found = {p.rsplit("/", 1)[0] for p, at in after if p.endswith(".summary.md") and at > started and (p, at) not in before and "/" in p}
    used, rest, out = set(taken), {p for p, _ in after}, {}
    new = sorted(f for f in found if f not in known and not any(f.startswith(g + "/") for g in found - known))
    every = used | {f.rsplit("/", 1)[-1] for f in new}
    for f in new:
        name = target = f.rsplit("/", 1)[-1]
        n = 1
        while target in used or (n > 1 and target in every):
            target = f"{name}.{n}"
            n += 1
            while target in every:
                target = f"{name}.{n}"
                n += 1
        used.add(target)
        gone = {p for p in rest if p.startswith(f + "/")}
        rest -= gone
        out[f] = ["move", f"_partial/{target}", len(gone), None]
    for f in new:
        around = f.rpartition("/")[0]
        if around and not any(p.startswith(around + "/") for p in rest):
            out[f][3] = around
    return {f: tuple(v) for f, v in out.items()} | {f: ("keep", None, 0, None) for f in found & known}


def test_quarantine(spark):
    rng = random.Random(7)
    moved = emptied = kept = many = 0
    for _ in range(2):
        paths = {"/".join(rng.choices("abv", k=rng.randint(0, 3)) + [rng.choice(["x.1", "y"])][: rng.randint(0, 1)] + [f"{rng.randint(0, 9)}{rng.choice(['.summary.md', '.pdf'])}"]) for _ in range(60)}
        after = [(p, rng.randint(0, 20)) for p in sorted(paths)]
        before = [(p, at if rng.random() < 0.5 else at - 1) for p, at in after if rng.random() < 0.15]
        taken = ["a", "a.1", "x.1"]
        got = {r.folder: (r.action, r.target, r.files, r.emptied) for r in recovery.quarantine(_files(spark, before), _files(spark, after), "1970-01-01 00:00:08", _names(spark, taken)).collect()}
        assert got == _plain(set(before), after, 8, taken)
        many += sum(v[2] > 1 for v in got.values())
        moved, emptied, kept = moved + sum(v[0] == "move" for v in got.values()), emptied + sum(v[3] is not None for v in got.values()), kept + sum(v[0] == "keep" for v in got.values())
    assert moved and emptied and kept and many
    none = _files(spark, [])
    assert recovery.quarantine(none, none, "1970-01-01 00:00:00", _names(spark, [])).count() == 0


def test_registered_rows_show_each_case(spark, sf):
    from libraryloom.plans import service_queries

    rows = service_queries.quarantine(spark, sf).collect()
    assert {r.action for r in rows} == {"move", "keep"} and any(r.emptied for r in rows)
    assert {r.action for r in service_queries.recovered(spark, sf).collect()} == {"return", "remove"}
