"""Texts with very many matches."""

import re

from sitepulse.llm import pii


def test_many_matches_in_one_text(spark):
    parts = [f"1.2.{i % 300}.{i % 7} x{i}@a.bc; " for i in range(6000)]
    text = "".join(parts)
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r.base for r in pii.find_personal_data(docs).collect()}
    address = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    expected = [("email", m.start(), m.end()) for m in mail.finditer(text)]
    expected += [
        ("ip", m.start(), m.end())
        for m in address.finditer(text)
        if all(int(p) <= 255 for p in m.group().split("."))
    ]
    assert [(s["kind"], s["start"], s["end"]) for s in found[1]] == expected and found[2] == []
    clean = pii.sanitise(docs.filter("doc_id = 1")).first().text
    assert clean.count("[EMAIL]") == 6000 and clean.count("[IP]") == len(expected) - 6000
