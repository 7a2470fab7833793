import hashlib
import random
import re

import pytest
import xxhash

from tarn.llm import fingerprints, licenses, pii

SEED = 42
M = 1 << 64


def signed(x):
    return x - M if x >= M // 2 else x


def hash_text(text, seed=SEED):
    return xxhash.xxh64_intdigest(text.encode(), seed=seed)


def hash_longs(values):
    seed = SEED
    for v in values:
        seed = xxhash.xxh64_intdigest((v % M).to_bytes(8, "little"), seed=seed)
    return seed


def hash_ints(values):
    """Spark hashes an int by a variant for four bytes, which is the plain one."""
    seed = SEED
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 32)).to_bytes(4, "little") if isinstance(v, int) else v.encode(), seed=seed)
    return seed


def shingle_hashes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = [hash_text(w) for w in words]
    if not h:
        return []
    if len(h) < 5:
        return [hash_longs(h)]
    return [hash_longs(h[i : i + 5]) for i in range(len(h) - 4)]


def plain_fingerprint(text):
    bins = {}
    for x in shingle_hashes(text):
        s = signed(x)
        b = (s >> 57) + 64
        bins[b] = min(bins.get(b, s), s)
    if not bins:
        return ""
    out = []
    for b in range(128):
        value = bins.get(b)
        if value is None:
            h = signed(hash_ints([b]))
            at, step = h % 128, 2 * ((h >> 32) % 64) + 1
            value = next(v for t in range(128) if (v := bins.get((at + t * step) % 128)) is not None)
        low = value & 255
        out.append(f"{low:02x}")
    return "".join(out)


def plain_likeness(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    agree = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 256, 2)) / 128
    return max((agree - 1 / 256) / (1 - 1 / 256), 0.0)


def test_fingerprints_equal_the_plain_version(docs, texts):
    found = {r["doc_id"]: r for r in fingerprints.compare_neighbours(docs).collect()}
    n = len(texts)
    assert len(found) == n
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i - 1) % n] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = found[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == plain_fingerprint(text)
        assert r["edited_fingerprint"] == plain_fingerprint(edited)
        assert r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(plain_likeness(r["fingerprint"], plain_fingerprint(after)))


def test_fingerprint_edges(spark, no_docs, twice, texts):
    assert fingerprints.compare_neighbours(no_docs).count() == 0
    assert fingerprints.compare_neighbours(twice).count() == 2 * len(texts) + 2
    one = fingerprints.compare_neighbours(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_rows_that_repeat_often_are_worked_off_once(spark, monkeypatch):
    """Equal, whether or not they are gathered, and with one text after another for ids and null ids that repeat."""
    rows = [(7, "a b c d e f")] * 40 + [(None, "x y z")] * 30 + [(7, f"other {i}") for i in range(25)] + [(None, f"none {i}") for i in range(25)] + [(i, f"text {i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = sorted(map(repr, fingerprints.compare_neighbours(df).collect()))
    monkeypatch.setattr(fingerprints, "HOT_ROWS", 10)
    assert sorted(map(repr, fingerprints.compare_neighbours(df).collect())) == plain and len(plain) == len(rows)
    named = df.withColumnRenamed("doc_id", "id")
    made = fingerprints.with_next(fingerprints._once(named, fingerprints._several(named)), ["text"])
    assert made.count() == 2 + 25 + 25 + 3


def test_null_ids_spread_over_buckets(spark):
    rows = spark.range(4000).selectExpr("cast(null as long) id", "concat('text ', id) text")
    found = fingerprints.with_next(rows, ["text"])
    texts = [(r["text"], r["next"]["text"]) for r in found.collect()]
    assert len({a for a, _ in texts}) == len({b for _, b in texts}) == 4000
    sizes = [len(p) for p in found.rdd.glom().collect()]
    assert max(sizes) < 4000


def test_next_row_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHAIN_ROWS", 2)
    ids = [0, 1, 511, 512, 5000, 5001, 300_000, 300_001, 9_000_000, -3, -600, 10**15]
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "id long, text string")
    found = {r["id"]: int(r["next"]["text"]) for r in fingerprints.with_next(rows, ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert found == {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}


def plain_scan(text):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = word.findall(low)
    starts, base = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split(" ")
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    own, best = set(), 0.0
    for label, template in licenses.TEMPLATES:
        t = set(licenses.template_words(template))
        stretch = licenses.stretch_words(template, 0.8)
        for i in (i for i, w in enumerate(words) if w in t):
            held = set(words[i : i + stretch])
            if len(held & t) >= 0.8 * len(t) - 1e-9 and t & licenses.NAMES <= held:
                own.add(label)
                best = max(best, len(held & t) / len(t))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if starts else best


def test_licenses_equal_the_plain_version(spark, docs, texts):
    extra = ["Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "licensed under the apache license version 2", "Kelvin worK is licensed under the GNU General Public License", "this source code form is subject to terms of the mozilla public license v 2 0", "cc by" * 3, " ".join(["license the mit under released license"] * 300), " ".join(["word license"] * 40 + ["released under the mit"] * 3 + ["x"] * 30 + ["the license"] * 70), " ".join(["filler"] * 50 + ["released under the mit license"] + ["filler"] * 90)]
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs.select("doc_id", "text").unionByName(more)).collect()}
    every = dict(enumerate(texts)) | {10_000 + i: t for i, t in enumerate(extra)}
    assert {i: f[:6] for i, f in found.items()} == {i: plain_scan(t)[:6] for i, t in every.items()}
    assert all(found[i][6] == pytest.approx(plain_scan(t)[6]) for i, t in every.items())
    assert any(f[5] for f in found.values())


def test_license_edges(no_docs, twice, texts):
    assert licenses.scan(no_docs).count() == 0
    assert licenses.scan(twice).count() == 2 * len(texts) + 2


def license_labels(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["labels"] for r in sorted(licenses.scan(rows).collect())]


def test_wrapped_templates_are_met(spark):
    wrapped = [
        "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met",
        " ".join(["filler"] * 37) + "\n * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0",
    ]
    assert license_labels(spark, wrapped) == ["mit", "bsd", "mpl-2.0"]


def test_scattered_words_are_no_template(spark):
    assert license_labels(spark, ["released\nfiller one two three four\nunder the old terms of\nsome mit people with a license"]) == [""]


def test_templates_need_their_names(spark):
    other = ["Released under the Apache License", "Licensed under CC BY 4.0", "Licensed under the Mozilla Public License, Version 2.0", "This work is licensed under the GNU General Public License, version 2"]
    own = ["Released under MIT License", "Licensed under CC BY-NC 4", "Licensed under Apache License, Version 2.0", "work is licensed under the GNU General Public License, version 3"]
    assert license_labels(spark, other) == ["", "cc-by", "", "gpl"]
    assert license_labels(spark, own) == ["mit", "cc-by,cc-by-nc", "apache-2.0", "gpl,gpl-3.0"]
    assert license_labels(spark, ["license one two three released four five six under seven eight nine the ten mit"]) == [""]


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return (sum(digits[0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def one(spark, *texts, key="k"):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, N_PII string")
    return [r for r in sorted(pii.pseudonymize(rows, key).toDF("doc_id", "text", "n", "kinds").collect())]


def test_pseudonyms_keep_their_formats(spark):
    got = one(
        spark,
        "card 4539148803436467, 4539 1488 0343 6467",
        "mail ab.c9@example.com",
        "on 2024-02-29 and 12/25/1999 and 25.12.1999",
        "call +1 (663) 555-6869",
        "DE89 3704 0044 0532 0130 00",
        "ssn 123-45-6789",
        "ip 10.20.30.40",
        'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"',
        "password=abcDEF123",
    )
    text = [r["text"] for r in got]
    a, b = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", text[0])
    assert a == b.replace(" ", "") != "4539148803436467" and luhn(a) and a[0] == "4"
    assert re.fullmatch(r"mail [a-z]{2}\.[a-z]\d@example\.com", text[1]) and "ab.c9" not in text[1]
    iso = re.search(r"\d{4}-02-29", text[2])
    assert iso and int(iso[0][:4]) % 4 == 0
    assert re.fullmatch(r"call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", text[3]) and "555-6869" not in text[3]
    iban = text[4].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "DE"
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", text[5])
    assert all(int(o) < 256 for o in text[6][3:].split("."))
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', text[7]) and "1beb58" not in text[7]
    assert re.fullmatch(r"password=[a-z]{3}[A-Z]{3}\d{3}", text[8])
    assert [r["kinds"] for r in got] == ["card", "email", "date", "phone", "iban", "ssn", "ip", "secret", "secret"]


def test_numbers_beside_numbers_are_found(spark):
    texts = [
        "4111 1111 1111 1111 12/25", "4111 1111 1111 1111 123", "order 12 4111111111111111", "1234 5678 4111 1111 1111 1111 99",
        "BE68 5390 0754 7034 EUR", "AB13 BE68 5390 0754 7034 EUR", "AB12 4111 1111 1111 1111 X", "555-123-4567 4111-1111-1111-1111 2024-03-05", "12 41111111 11111111 12",
        "4111 1111 1111 1111 12/25/1999", "4111 1111 1111 1111 10.20.30.40", "AB12 CDEF GHIJ JOHN.DOE@example.com", "4111 1111 1111 1111 " + "7 " * 9000,
    ]
    got = one(spark, *texts)
    assert [r["kinds"] for r in got] == ["card"] * 4 + ["iban", "iban", "card", "card,date,phone", "card", "card,date", "card,ip", "email", "card"]
    for t, r in zip(texts, got, strict=True):
        assert "1111 1111" not in r["text"] and "11111111" not in r["text"] and "5390" not in r["text"] and "123-4567" not in r["text"]
        assert re.sub("[0-9]", "0", t)[:4] == re.sub("[0-9]", "0", r["text"])[:4] and (len(t) == len(r["text"]) or "ip" in r["kinds"])
    assert got[0]["text"].endswith(" 12/25") and got[2]["text"].startswith("order 12 4") and got[4]["text"].endswith(" EUR") and got[5]["text"].startswith("AB13 BE")


def test_long_secrets_are_replaced_whole(spark):
    value = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789", k=3000))
    (got,) = one(spark, f"token={value} end")
    assert re.fullmatch("token=[A-Za-z0-9]{3000} end", got["text"]) and got["n"] == 1
    out = got["text"][6:-4]
    assert not any(value[i : i + 12] in out for i in range(0, 2989))


def test_what_is_not_valid_stays(spark):
    clean = ["card 4539148803436468", "ip 999.1.1.1", "2023-02-29 31/31/2020", "000-12-3456", "plain text, 42 things = 7 @ home", "DE00 3704 0044 0532 0130 00", None, ""]
    assert [(r["text"], r["n"]) for r in one(spark, *clean)] == [(t, 0) for t in clean]


def test_pseudonyms_are_a_permutation(spark):
    dates = [f"{y}-01-01" for y in range(1900, 2100)]
    got = [r["text"] for r in one(spark, *dates)]
    assert len(set(got)) == len(dates)
    octets = [f"10.0.0.{i}" for i in range(256)]
    assert len({r["text"] for r in one(spark, *octets)}) == 256
    assert one(spark, "10.0.0.1", key="other")[0]["text"] != one(spark, "10.0.0.1")[0]["text"]
    assert one(spark, "10.0.0.1 10.0.0.1")[0]["text"].split(" ")[0] == one(spark, "x 10.0.0.1")[0]["text"].split(" ")[1]


def test_pii_edges(docs, no_docs, twice, texts):
    assert pii.pseudonymize(no_docs, "k").count() == 0
    found = pii.pseudonymize(docs, "k")
    assert found.columns == [*docs.columns, "n_pii", "pii_kinds"] and found.count() == len(texts)
    assert pii.pseudonymize(twice, "k").count() == 2 * len(texts) + 2


def test_dates_are_linked_across_notations(spark):
    same = one(spark, "2020-01-05", "01/05/2020", "05.01.2020", "1/5/2020", "2020-10-25", "25/10/2020", "10/25/2020", "25.10.2020", "2021-03-31", "31.03.2021")
    iso, slash, dots, short, *late = [r["text"] for r in same]
    y, m, d = iso.split("-")
    assert iso != "2020-01-05" and slash == f"{m}/{d}/{y}" and dots == f"{d}.{m}.{y}" and short == f"{int(m)}/{int(d)}/{y}"
    y, m, d = late[0].split("-")
    assert late[1:4] == [f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{d}.{m}.{y}"]
    assert late[5].split(".") == late[4].split("-")[::-1]


def test_patterns_take_very_long_runs(spark):
    n = 20_000
    runs = [
        "x@y" + ".a" * n, "token=" + "aB3" * n, "1.2.3" + ".4" * n, "2020-01-01" * n, "1/1/2020/" * n, "123-45-6789-" * n, "DE89 3704 0044 " + "0532 " * n, "AB12" * n, "4111 " * n, "1-" * n + "1a",
        "1" * n + "a", "+1 " + "(555) " * n, "+4" + "4.12" * n, "@" * n, "a@" * n, "=" * n, "token=" * n, "password" * n, "1.1" * n, "(555)" * n, "4111 1111 1111 1111 " * (n // 4),
    ]
    got = one(spark, *runs)
    assert len(got) == len(runs) and [len(r["text"]) for r in got[:2]] == [len(runs[0]), len(runs[1])]
    assert got[0]["kinds"] == "email" and got[1]["kinds"] == "secret" and runs[1][6:] not in got[1]["text"]


def plain_feistel(values, radices, tweak, key):
    vs = list(values)
    half = len(vs) // 2
    for t in range(pii.ROUNDS):
        moved = [(j < half) == (t % 2 == 0) for j in range(len(vs))]
        other = ",".join("" if m else str(v) for m, v in zip(moved, vs, strict=True))
        h = hashlib.sha256("|".join([key, tweak, ",".join(map(str, radices)), str(t), other]).encode()).hexdigest()
        vs = [(v + signed(hash_ints([h, j]))) % r if m else v for j, (m, v, r) in enumerate(zip(moved, vs, radices, strict=True))]
    return vs


def plain_pseudonym(text, key="k"):
    """Pseudonyms of single values, by kind."""
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", text):
        return ".".join(map(str, plain_feistel(map(int, text.split(".")), [256] * 4, "ip", key)))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", text):
        a, b, c = map(int, text.split("-"))
        a, b, c = plain_feistel([a - (2 if a > 666 else 1), b - 1, c - 1], [898, 99, 9999], "ssn", key)
        return f"{a + (1 if a < 665 else 2):03}-{b + 1:02}-{c + 1:04}"
    if re.fullmatch(r"\d{16}", text):
        body = text[0] + "".join(map(str, plain_feistel(map(int, text[1:15]), [10] * 14, "card", key)))
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if "@" in text:
        own, rest = text.split("@")
        base = {c: (("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26)) for c in own if c.isalnum()}
        live = [c for c in own if c in base]
        out = iter(plain_feistel([ord(c) - ord(base[c][0]) for c in live], [base[c][1] for c in live], "email", key))
        return "".join(chr(ord(base[c][0]) + next(out)) if c in base else c for c in own) + "@" + rest
    y, m, d = map(int, text.split("-"))
    years = [n for n in range(1900, 2100) if (n % 4 == 0 and n != 1900) == (y % 4 == 0 and y != 1900)]
    days = [d] if d > 28 else list(range(13, 29)) if d > 12 else list(range(1, 13))
    months = [m] if d > 28 else list(range(1, 13))
    sets = [years, months, days]
    live = [s for s in sets if len(s) > 1]
    out = iter(plain_feistel([s.index(v) for s, v in zip(sets, (y, m, d), strict=True) if len(s) > 1], [len(s) for s in live], "date", key))
    y, m, d = [s[next(out)] if len(s) > 1 else s[0] for s in sets]
    return f"{y}-{m:02}-{d:02}"


def test_pseudonyms_equal_the_plain_version(spark):
    rng = random.Random(8)
    number = ["4" + "".join(rng.choices("0123456789", k=14)) for _ in range(60)]
    values = [next(b + str(d) for d in range(10) if luhn(b + str(d))) for b in number]
    values += [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(60)]
    values += [f"{rng.choice([1, 42, 665, 667, 899]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}" for _ in range(60)]
    values += ["".join(rng.choices("abcxyzABC0189._", k=9)) + f"q@host{i}.org" for i in range(60)]
    values += [f"{rng.randrange(1900, 2100)}-{rng.choice([1, 3, 5, 7, 8, 10, 12]):02}-{rng.randrange(1, 32):02}" for _ in range(120)]
    assert [r["text"] for r in one(spark, *values)] == [plain_pseudonym(v) for v in values]
