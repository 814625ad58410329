import gzip
import hashlib

from pyspark.sql import functions as F

from plumbline.llm import arc_convert as arc, fingerprints as fp


def test_round_trip(spark):
    body = "é" * 60
    rows = [(5, "http://a/x y", body), (3, "http://a/2", body), (9, None, body), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", "a\r\n\r\nWARC/1.1\r\n\n" * 20), (6, "u", "a\r\n\r\nWARC/1.1\r\n\n" * 20)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = sorted((int(r["key"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["error"]) for r in arc.archive_pages(pages).collect())
    want = []
    for key, _, html in rows:
        data = (html or "").encode()
        again = html == body and key != 3
        want.append((key, "revisit" if again else "response", "3" if again else None, len(data), hashlib.sha256(data).hexdigest(), None))
    assert got == sorted(want)
    assert arc.archive_pages(pages.limit(0)).count() == 0


def test_versions_and_broken_files(spark, tmp_path):
    about1 = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    about2 = b"2 0 x\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    one = b"filedesc://a 0.0.0.0 20000101000000 text/plain %d\n" % len(about1) + about1 + b"\nhttp://a/ 1.2.3.4 19990102030405 text/plain 5\nhello\n"
    two = b"filedesc://b 0.0.0.0 20000101000000 text/plain 200 - - 0 b %d\n" % len(about2) + about2 + b"\nhttp://b/ 1.2.3.4 19990102030405 text/plain 404 - - 0 b 3\nabc\n\nhttp://c/ 1 2 t 200 - - 0 b 99\nabc\n"
    for name, data in {"part-1.gz": gzip.compress(one), "part-2": two, "part-3.gz": gzip.compress(one)[:-20], "part-4": b"junk\n", "part-5": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {(r["file"], r["url"], r["status"], bytes(r["payload"]) if r["payload"] is not None else None, r["error"] is None) for r in arc.read_arc(spark, str(tmp_path)).collect()}
    assert ("part-1.gz", "http://a/", None, b"hello", True) in got and ("part-2", "http://b/", "404", b"abc", True) in got
    assert {g[0] for g in got if not g[4]} >= {"part-2", "part-3.gz", "part-4"}


def test_dates_and_ids():
    assert arc.warc_date("19990102030405") == "1999-01-02T03:04:05Z" and arc.warc_date("19991302030405") == "1970-01-01T00:00:00Z"
    assert arc.record_id("a", "b") == arc.record_id("a", "b") != arc.record_id("a", "c")


def test_tree_locates_edits():
    text = "Title line.\n\nFirst words of a paragraph here.\nSecond one follows.\n\nLast section, with words."
    other = text.replace("Second one", "Second two")
    a, b = fp.fingerprint(text), fp.fingerprint(other)
    assert fp.differing(a, b) == [(1, 1)] and fp.differing(a, a) == []
    assert 0.7 < fp.likeness(a, b) < 1 and fp.likeness(a, a) == 1 and fp.likeness(a, fp.fingerprint("zzz qqq")) < 0.2
    assert "".join(leaf for p in fp.PARAGRAPH.findall(text) for leaf in fp.LEAF.findall(p)) == text
    long = "x" * 100_000
    assert "".join(fp.LEAF.findall(long)) == long and fp.fingerprint(long) != fp.fingerprint(long + "x")
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint(None)) == 1 and fp.likeness(fp.fingerprint(""), a) == 0


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (name, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edit = text[:len(text) - half] + following[:half]
        marks = [fp.fingerprint(x) for x in (text, edit, following)]
        out[name] = (len(text), hashlib.sha256(edit.encode()).hexdigest(), marks[0], marks[1], fp.likeness(marks[0], marks[1]), fp.likeness(marks[0], marks[2]))
    return out


def test_next_document_by_brute_force(spark, docs):
    rows = [(k * 7 % 211, f"Text number {k}. " * (k % 9)) for k in range(211)]
    rows[5] = (rows[5][0], None)
    got = {r["doc_id"]: tuple(r)[1:] for r in fp.compare_with_next(docs(rows).repartition(4)).collect()}
    assert got == brute(rows)


def test_fingerprint_edges(spark, docs):
    assert fp.compare_with_next(docs([])).count() == 0
    one = fp.compare_with_next(docs([(1, "a b c")])).first()
    assert one["near_next"] == 1 and one["n_chars"] == 5
    ties = fp.compare_with_next(docs([(1, "a"), (1, "a"), (1, "b"), (None, "n"), (None, None)])).collect()
    assert len(ties) == 5
    again = fp.fingerprints(docs([(1, "a"), (1, "a"), (2, None)])).collect()
    assert again[0] == again[1] and again[2]["fingerprint"] == fp.EMPTY
    assert spark.range(0).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).transform(fp.fingerprints).count() == 0
