"""Licence notices on the query's operator: wrapped, embedded, repeated, without an id, look-alikes."""

import textwrap

import pytest

from folioscope.llm import licence_scan

PROSE = "The valley was quiet that morning and nobody of the village had seen the river so low"


@pytest.fixture(scope="module")
def model(spark):
    return licence_scan.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def found(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_notices, r.families) for r in licence_scan.licences(docs, model).collect()}


def all_notices():
    return [(family, text) for family, notices in licence_scan.TEMPLATES.items() for text in notices]


@pytest.mark.parametrize(
    "shape",
    [
        lambda t: t,
        lambda t: f"{PROSE}.\n{t}\n{PROSE}.",
        lambda t: "\n".join(textwrap.wrap(t, 40)),
        lambda t: "/*\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, 50)) + "\n */\nint main() {}",
        lambda t: f"{PROSE} {t} {PROSE}",
        lambda t: f"{PROSE}, and {t.upper()} so they said; {PROSE}",
    ],
    ids=["alone", "a line", "wrapped", "a comment", "in a line", "in capitals"],
)
def test_planted_notices_of_all_families(spark, model, shape):
    planted = all_notices()
    got = found(spark, model, [shape(text) for _, text in planted])
    right = sum(got[i] == (1, family) for i, (family, _) in enumerate(planted))
    named = sum(n > 0 for n, _ in got.values())
    print(f"recall {right / len(planted):.3f}, precision {right / max(1, named):.3f}", [(got[i], t[:50]) for i, (f, t) in enumerate(planted) if got[i] != (1, f)])
    assert right >= 0.9 * len(planted) and right >= 0.95 * named


def test_a_wrapped_header_keeps_its_family(spark, model):
    header = (
        "This program is free software: you can redistribute it and/or modify\n"
        "it under the terms of the GNU General Public License as published by\n"
        "the Free Software Foundation, either version 3 of the License, or\n"
        "(at your option) any later version."
    )
    lesser = header.replace("program", "library").replace("GNU General", "GNU Lesser General")
    assert found(spark, model, [header, lesser, f"{header}\n\n{lesser}"]) == {0: (1, "GPL"), 1: (1, "LGPL"), 2: (2, "GPL LGPL")}


def test_rows_are_counted_by_themselves(spark, model):
    text = "Released under the MIT License."
    rows = [(1, text, 9), (1, text, 9), (None, text, 9), (2, f"{text}\nLicensed under CC BY-NC 4.0.", 9), (3, None, 9), (4, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_notices long")
    got = sorted(((r.doc_id, r.n_notices, r.families) for r in licence_scan.licences(docs, model).collect()), key=repr)
    assert got == sorted([(1, 1, "MIT"), (1, 1, "MIT"), (None, 1, "MIT"), (2, 2, "CC-BY-NC MIT"), (3, 0, ""), (4, 0, "")], key=repr)


def test_lookalikes_are_no_notices(spark, model):
    more = ["The program of the concert is free of charge for any person.", "You may not use this file as a doorstop.", "The general public was admitted to the library."]
    got = found(spark, model, [*licence_scan.LOOKALIKES, " ".join(licence_scan.LOOKALIKES), *more, *(f"{PROSE}. {x}\n{PROSE}" for x in more)])
    assert set(got.values()) == {(0, "")}


def test_spans_are_those_of_the_notice(spark, model):
    text = f"{PROSE}.\nÉté.\n# Licensed under the Apache License,\n# Version 2.0.\n{PROSE}."
    row = licence_scan.notices(spark.createDataFrame([(5, text)], "doc_id long, text string"), model).first()
    assert (row.line, row.family) == (2, "Apache-2.0")
    assert text.encode()[row.start : row.end].decode() == "Licensed under the Apache License,\n# Version 2.0."
