import re

from cartlytics.llm import licenses as X
from conftest_llm import ODD, frame, sentence

LOWER = str.maketrans(X.UPPER, X.LOWER)


def expected(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = sorted((j, label) for p, label in X.PHRASES.items() for q in [p.split()] for j in range(len(ws) - len(q) + 1) if ws[j:j + len(q)] == q)
    return len(ws), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at}))


TEXTS = ["Licensed under the Apache License, Version 2.0.", "cc by cc by-cc BY", "MIT\nLicense mit license", "the GNU General Public License v3",
         "gnu general public", "ÀMIT License", "mit_license", "Licensed under CC BY-NC 4.0.", sentence(3, 200) + " Apache License " + sentence(4, 50),
         "GNU GENERAL PUBLIC LICENSE gnu general public license apache license", "mit  License. Released under the MIT License",
         "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
         "Permission is hereby granted, free of charge, to any person obtaining a copy", "permission to use free software"]


def test_places_of_phrases(spark, odd):
    rows = [(i, t, "a") for i, t in enumerate(TEXTS)]
    for frame_, want in ((frame(spark, rows), rows), (odd, ODD)):
        got = X.scan(frame_).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr) == sorted(((i, *expected(t)) for i, t, _ in want), key=repr)
        for r in got:
            assert {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1


def test_notices_add_labels(spark):
    got = {r["doc_id"]: r["labels"] for r in X.scan(frame(spark, [(i, t, "a") for i, t in enumerate(TEXTS)])).collect()}
    assert got[7] == "cc-by,cc-by-nc" and got[11] == "bsd" and got[12] == "mit" and got[13] == "" and got[4] == ""


def test_table_and_empty(spark, docs, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in X.scan(docs).collect()}
    assert got == {r["doc_id"]: expected(r["text"]) for r in docs.collect()}
    assert X.scan(empty).count() == 0


def test_phrases_of_a_notice_stand_at_their_places(spark):
    notice = next(ws for label, ws, must in X.NOTICES if label == "mit" and "free of charge" in must)
    apart = notice.replace("free of charge", "one two three") + " " + sentence(5, 60) + " free of charge"
    texts = [notice, notice.replace("hereby granted free", "hereby granted entirely free"), apart, "free of charge " + apart]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in X.scan(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got == {0: ("mit", 1.0), 1: ("mit", 1.0), 2: ("", 0.0), 3: ("", 0.0)}
    for _, ws, must in X.NOTICES:
        assert must and all(X._offsets(ws.split(), m.split()) for m in must)


def test_each_notice_is_found_in_itself(spark):
    texts = [sentence(i, 20 + i) + " " + ws.upper() + ". " + sentence(i + 50, 9) for i, (_, ws, _) in enumerate(X.NOTICES)]
    got = {r["doc_id"]: r for r in X.scan(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] == 1.0 for i, (label, _, _) in enumerate(X.NOTICES))


def test_a_bank_of_hundreds_is_a_parameter(spark):
    phrases = {f"licence number n{i}": f"l{i}" for i in range(300)}
    notices = [(f"notice{i}", f"this file may be used as word{i} of clause{i} says", [f"clause{i} says"]) for i in range(300)]
    rows = [(i, f"Here licence number N{i} and so: this file may be used as word{i} of clause{i} says. licence number n{(i + 1) % 300}", "a") for i in range(0, 300, 7)]
    got = {r["doc_id"]: r for r in X.scan(frame(spark, rows), phrases, notices).collect()}
    for i in range(0, 300, 7):
        assert got[i]["n_base"] == 2 and got[i]["first_word"] == 1 and got[i]["base_labels"] == ",".join(sorted([f"l{i}", f"l{(i + 1) % 300}"]))
        assert f"notice{i}" in got[i]["labels"].split(",") and len(got[i]["labels"].split(",")) == 3
    assert X.scan(frame(spark, rows), {}, []).first()["labels"] == ""
