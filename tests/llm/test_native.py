import os
import re
import textwrap
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.licenses import DIGESTS, HINTS, KNOWN, canonical, canonical_text, digest_of, known_digests, license_scan
from quern.llm.quality import RULES, keep_good, order_rules, quality
from quern.llm.queries import oracle_sql, queries

from ..conftest import SF
from .cases import empty, odd, odd_rows, prose, words

PYTHON = re.compile("Python|Pandas|Arrow")


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_rows(spark):
    extra = ["a b c d e a b c d e", "a a a a a a a a a a a a", "x\nx\n x\n\n\n", "# * $ % & | < > ab", "p q r s t u p q r s t v w p q r s t", "one two three four five"]
    df = odd(spark).unionByName(spark.createDataFrame([(100 + i, t, "en", "s", 1) for i, t in enumerate(extra)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    rows = quality(df).collect()
    want = Counter((i, *base(t)) for i, t in [(r[0], r[1]) for r in odd_rows()] + [(100 + i, t) for i, t in enumerate(extra)])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept) and (r.rejected_by is None or not r.kept)
    assert quality(empty(spark)).collect() == []


def test_the_order_of_rules_never_changes_the_rows(spark):
    df = odd(spark)
    out = keep_good(df)
    assert out.columns == df.columns
    ids = lambda x: sorted(str(r.doc_id) for r in x.collect())
    assert ids(out) == ids(keep_good(df, RULES[::-1])) == sorted(str(r.doc_id) for r in quality(df).collect() if r.kept)
    assert {r.name for r in order_rules(df)} == {r.name for r in RULES}
    assert keep_good(empty(spark)).collect() == []


def test_clean_prose_is_kept(spark):
    df = spark.createDataFrame([(i, prose(i, 20 + i)) for i in range(50)], "doc_id long, text string")
    assert keep_good(df).count() == 50


def test_licences(spark):
    mit = dict(KNOWN[:1])["MIT"]
    texts = [mit, "MIT License\n" + mit, "Copyright (c) 2020 Me\n\n" + mit.upper().replace(",", " ;"), "Some text.\n  * Licensed under the APACHE licence, version 2.0!\nMore\nReleased under the MIT License.", "nothing", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license, r.notices) for r in license_scan(df).collect()}
    assert got == {0: ("MIT", []), 1: ("MIT", []), 2: ("MIT", []), 3: (None, ["Apache-2.0", "MIT"]), 4: (None, []), 5: (None, []), 6: (None, [])}
    out = license_scan(odd(spark))
    assert out.count() == len(odd_rows()) and license_scan(empty(spark)).collect() == []


LONG = [(name, text) for name, text in KNOWN if len(text) > 500]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(LONG), st.integers(50, 120), st.sampled_from(["", "# ", " * ", "// ", "; ", "> ", "\t"]), st.sampled_from(["n.", "(n)", "n)", "-", "*", "\u2022", "a."]), st.sampled_from(["", "Copyright (c) 2021 Some One\nAll rights reserved.\n\n", "\u00a9 1999, 2004 X. Y.\n(c) 2005 Z <z@y.x>\n", "Portions Copyright: 2020 Me\r\n"]))
def test_any_layout_keeps_the_licence(entry, width, mark, bullet, notice):
    name, text = entry
    parts = []
    for k, part in enumerate(text.split("\n")):
        item = re.sub(r"^[0-9]\. ", "", part)
        if item != part:
            part = bullet.replace("n", item and str(k)).replace("a", "abcdef"[k]) + " " + item
        parts.append("\n".join(textwrap.wrap(part, width)))
    laid = "\n".join(mark + x for x in (notice + "\n\n".join(parts)).split("\n"))
    for form in (laid, laid.upper(), laid.replace("organization", "organisation").replace("&", "and")):
        assert known_digests()[digest_of(form)] == name


def test_titles_and_holders_names():
    texts = {name: text for name, text in reversed(LONG)}
    for title, name in (("The MIT License (MIT)", "MIT"), ("ISC License", "ISC"), ("BSD 3-Clause License", "BSD-3-Clause"), ("Simplified BSD License", "BSD-2-Clause"), ("zlib License", "Zlib"), ("BSD Zero Clause License", "0BSD")):
        assert known_digests()[digest_of(f"{title}\n\nCopyright (c) 2020, Me\n\n{texts[name]}")] == name
    regents = texts["BSD-3-Clause"].replace("the copyright holder nor", "the University nor").replace("THE COPYRIGHT HOLDERS AND", "THE REGENTS AND").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR")
    assert known_digests()[digest_of(regents)] == "BSD-3-Clause"
    for other in (texts["MIT"].replace("without restriction", "with restriction"), texts["MIT"] + " More.", "MIT License", "Licensed under the GNU General Public License, version 2."):
        assert digest_of(other) not in known_digests()


def test_long_licences_by_digest():
    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.1-only": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    if not os.path.isdir(folder):
        pytest.skip("no licence texts on this machine")
    for name, file in files.items():
        with open(f"{folder}/{file}") as f:
            assert (name, digest_of(f.read())) in DIGESTS


def test_every_notice_holds_a_hint():
    assert all(any(h in text.lower() for h in HINTS) for _, text in KNOWN if "\n" not in text)


def test_known_texts_of_ones_own(spark):
    df = spark.createDataFrame([(1, "Be kind, it's ours."), (2, "x\nBE KIND - it's ours\ny")], "digest long, text string")
    rows = {r[0]: (r.license, r.notices) for r in license_scan(df.withColumnRenamed("digest", "own"), id_col="own", known=[("O'Wn", "be kind; it's ours")]).collect()}
    assert rows == {1: ("O'Wn", ["O'Wn"]), 2: (None, ["O'Wn"])}
    assert [(r.license, r.notices) for r in license_scan(df.withColumnRenamed("digest", "own"), id_col="own", known=[]).collect()] == [(None, [])] * 2
    odd_names = license_scan(df.withColumnsRenamed({"digest": "known"}), id_col="known").collect()
    assert sorted(r.known for r in odd_names) == [1, 2]


@pytest.mark.parametrize("text", [t for _, t in KNOWN[:4]] + ["  Ünï & co. https://x.y\n// Copyright 2020\n(c) me\nAll rights reserved", "", "© x"])
def test_canonical_forms_agree(spark, text):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(canonical(F.col("t"))).first()[0] == canonical_text(text)


@pytest.mark.parametrize("name", ["op6_license_scan", "op8_quality_rules"])
def test_no_python_in_the_plan(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not PYTHON.search(plan)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    df = queries()[name](spark, SF)
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = c.sql(oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
