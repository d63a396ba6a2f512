from pyspark.sql import functions as F

from vecloom.llm.licenses import MIT, NOTICES, license_scan


def test_scan(spark, docs):
    british = MIT.replace("sublicense", "sub-licence").replace("MERCHANTABILITY", "merchantibility")
    texts = {
        0: (MIT, "MIT"), 1: ("Copyright (c) 2020 Someone Else\n\n" + MIT.upper(), "MIT"), 2: ("  " + " -- ".join(british.split(", ")) + "\n", "MIT"), 3: (MIT + " And more.", None),
        4: (None, None), 5: ("", None), 6: ("...", None), 7: ("The MIT License\n© 2001 X\nAll rights reserved.\n" + MIT.replace(" ", "\n"), "MIT"), 8: ("word " * 30_000, None),
    }
    rows = [(d, t) for d, (t, _) in texts.items()] + [(0, MIT)]
    out = license_scan(docs(*rows).withColumnRenamed("n_chars", "license")).collect()
    assert len(out) == len(rows) and all(r.license == texts[r.doc_id][1] for r in out)
    assert all((r.digest is None) == (r.doc_id == 4) for r in out)


def test_notices(spark, docs):
    out = license_scan(docs((1, "prose\n licensed under the apache LICENCE version 2.0\nprose"), (2, "prose"), (3, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (4, None))).collect()
    assert {r.doc_id: r.notices for r in out} == {1: "Apache-2.0", 2: "", 3: "CC-BY-NC-4.0,MIT", 4: ""}


def test_every_notice_is_looked_up():
    assert all(any(x in t.lower() for x in ("licen", "releas", "copyright")) for _, t in NOTICES)


def test_own_table_and_empty(spark, docs):
    from vecloom.llm.licenses import known

    texts = known(spark, (("b", "My text!"), ("a", "my TEXT")))
    assert [r.license for r in license_scan(docs((1, "my, text")), texts).collect()] == ["a"]
    assert license_scan(docs((1, "x")).limit(0)).collect() == []


def test_common_licenses(spark, docs):
    from vecloom.llm.licenses import files

    folder = files("vecloom.llm").joinpath("license_texts")
    texts = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir()}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    rows, want = [], []
    for name, text in sorted(texts.items()):
        joined = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
        for t in (text, "Copyright (c) 2020, Someone Else\n\n" + text.replace("Licence", "License"), text.upper(), joined, text.partition("END OF TERMS AND CONDITIONS")[0]):
            rows.append((len(rows), t))
            want.append(name)
        rows.append((len(rows), text + "\nAnd more."))
        want.append(None)
    got = {r.doc_id: r.license for r in license_scan(docs(*rows)).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_sql_of_common_licenses(spark, docs):
    import pytest

    duckdb = pytest.importorskip("duckdb")
    from vecloom.llm.licenses import TEXTS
    from vecloom.llm.oracles import license_sql

    rows = [(i, t) for i, (_, t) in enumerate(TEXTS)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(tuple(r) for r in license_scan(docs(*rows)).collect()) == sorted(con.execute(license_sql()).fetchall())


def test_more_notices_than_are_broadcast(spark, docs):
    """Beyond the bound notices are joined like any table; nothing is refused."""
    from vecloom.llm.licenses import digest, known, license_scan

    many = spark.range(30_000).select(F.concat(F.lit("N"), "id").alias("license"), digest(F.concat(F.lit("Notice of licence "), "id")).alias("digest"))
    rows = [(1, "x\nnotice of license 29999\nNotice of licence: 7!\ny"), (2, "nothing"), (1, "Notice of licence 7"), (None, None), (3, "Notice of licence 7\nNOTICE OF LICENCE 7")]
    got = sorted((str(r.doc_id), r.notices) for r in license_scan(docs(*rows), known(spark), many).collect())
    assert got == [("1", "N29999,N7"), ("1", "N7"), ("2", ""), ("3", "N7"), ("None", "")]


def test_grant_in_the_copyright_line(spark, docs):
    """What follows the copyright statement in its line stays if it is a grant; SQL agrees."""
    import duckdb

    from vecloom.llm.licenses import ISC_GRANT, ISC_KEEP, ISC_WARRANTY
    from vecloom.llm.oracles import license_sql

    joined = " ".join(MIT.split())
    texts = {
        1: ("Copyright (c) 2020 Some One. " + joined, "MIT", ""), 2: ("Copyright 2020 A. B. Inc. All rights reserved. " + joined, "MIT", ""),
        3: (f"© 2001, X Co.; {ISC_GRANT}{ISC_KEEP}. " + ISC_WARRANTY, "ISC", ""), 4: ("(c) Y. Licensed under the MIT License.\nprose", None, "MIT"),
        5: ("Copyright 2019-2020 The Authors. This work is licensed under the GNU General Public License, version 2.", None, "GPL-2.0"),
        6: ("Copyright 2020 X. All rights reserved. No part may be copied.", None, ""), 7: ("Copyright 2020 X. Permission", None, ""), 8: ("Copyright " * 20_000 + "2020. " * 20_000, None, ""),
        9: ("Copyright 2020 X; licensed under CC BY 4.0\n(c) 2021 Z. Released under CC0 1.0.", None, "CC-BY-4.0,CC0-1.0"), 10: ("Copyright (c) 2020 X\n" + MIT + "\nCopyright 2021 Y. All rights reserved.", "MIT", ""),
    }
    rows = [(i, t) for i, (t, _, _) in texts.items()]
    got = license_scan(docs(*rows)).collect()
    assert {r.doc_id: (r.license, r.notices) for r in got} == {i: x[1:] for i, x in texts.items()}  # notices are known as lines, not as whole texts
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(tuple(r) for r in got) == sorted(con.execute(license_sql()).fetchall())
