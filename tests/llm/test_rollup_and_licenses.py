import pytest
from compare import difference, duck

from feederlake.llm import licenses, token_rollup
from feederlake.llm.queries import QUERIES, SQL
from feederlake.session import scratch_path

ALL = "*"


def change(key, op, tokens=None, old=None, group=("s", "en"), before=("s", "en")):
    new = group if op != "delete" else (None, None)
    was = before if op != "insert" else (None, None)
    return (key, op, "t1", *new, tokens, *was, old)


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_rollup(spark):
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "rollup-test"))
    assert totals(rollup) == {}
    first = spark.createDataFrame([change("a", "insert", 5), change("b", "insert", 7), change("b", "insert", 7),
                                   change("c", "insert", None, group=(None, "fr"))], token_rollup.CHANGES)
    rollup.commit(1, first)
    assert totals(rollup) == {("s", "en", "t1"): (2, 12), (None, "fr", "t1"): (1, 0)}
    second = spark.createDataFrame([change("a", "revise", 6, 5, group=("z", "en")), change("b", "delete", None, 7)],
                                   token_rollup.CHANGES)
    for _ in range(2):
        rollup.commit(2, second)
        rollup.commit(1, first)
        assert totals(rollup) == {("z", "en", "t1"): (1, 6), (None, "fr", "t1"): (1, 0)}
    rollup.commit(3, first.where("false"))
    assert totals(rollup) == {("z", "en", "t1"): (1, 6), (None, "fr", "t1"): (1, 0)}
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit(4, spark.createDataFrame([change("a", "upsert", 6, 5)], token_rollup.CHANGES))
    assert len(totals(rollup)) == 2


def test_only_published_attempts_count(spark):
    """A first commit that dies before it is published is not seen; one that is repeated leaves the old sums until then."""
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "rollup-test"))
    five, nine = (spark.createDataFrame([change("a", "insert", n)], token_rollup.CHANGES) for n in (5, 9))
    rollup.write_attempt(1, five)
    assert totals(rollup) == {}
    rollup.commit(1, five)
    again = rollup.write_attempt(1, nine)
    assert totals(rollup) == {("s", "en", "t1"): (1, 5)}
    rollup.publish(1, again)
    rollup.write_attempt(2, nine)
    assert totals(rollup) == {("s", "en", "t1"): (1, 9)}


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("LICENSE", mit), ("a/x.py", "code"), ("a/b/LICENSE.txt", apache), ("a/b/c/d/y.py", "code\nmore"), ("a/b/c/d/y.py", "code\nmore"),
        ("a/b/z.py", "# " + mit + "\ncode"), ("a/bc/w.py", ""), ("e/COPYING", "All rights reserved, copyright nobody"),
        ("e/v.py", None), (None, "code"), ("f/u.py", "line\n" * 50_000 + "This work is licensed under the GNU General Public License, version 3."),
    ]
    files = spark.createDataFrame([(p, t, "x", 2.0) for p, t in rows], "path string, text string, license string, score double")
    got = sorted(((r.path or "", r.license, r.origin, r.from_directory) for r in licenses.resolved(files).collect()), key=repr)
    assert got == sorted([
        ("LICENSE", "MIT", "header", None), ("a/x.py", "MIT", "inherited", ""), ("a/b/LICENSE.txt", "Apache-2.0", "header", None),
        ("a/b/c/d/y.py", "Apache-2.0", "inherited", "a/b"), ("a/b/c/d/y.py", "Apache-2.0", "inherited", "a/b"),
        ("a/b/z.py", "MIT", "header", None), ("a/bc/w.py", "MIT", "inherited", ""), ("e/COPYING", "MIT", "inherited", ""),
        ("e/v.py", "MIT", "inherited", ""), ("", "MIT", "inherited", ""), ("f/u.py", "GPL-3.0-only", "header", None)], key=repr)
    assert licenses.resolved(files.where("path <> 'LICENSE'")).where("path = 'a/x.py'").first().origin == "none"
    assert licenses.resolved(files.where("false")).count() == 0


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), duck(folder), SQL[name]) is None


def test_named_licences(spark):
    """A line that names a licence declares it, whatever stands around it; unknown names declare nothing."""
    names = sorted({i for i, _ in licenses.TEMPLATES})
    assert {"AGPL-3.0-only", "BSD-2-Clause", "ISC", "MIT"} <= set(names)
    files = [(f"{n}/{k}.c", f"{mark} SPDX-License-Identifier: {n}\nint x;") for n in names for k, mark in enumerate(("//", "#", " *"))]
    files += [("x.c", "// SPDX-License-Identifier: Zlib"), ("y.c", "no word of it"), ("z.c", None),
              ("a.py", "# Licensed under the GNU Affero General Public License, version 3."),
              ("g.py", "# This work is licensed under the GNU General Public License, version 3.")]
    rows = {r.path: r for r in licenses.declared(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: r.license for p, r in rows.items()} == {
        **{p: p.split("/")[0] for p, _ in files if "/" in p}, "a.py": "AGPL-3.0-only", "g.py": "GPL-3.0-only"}
    assert all(r.score > 0.99 for r in rows.values())
