"""Sizes of media from their bytes, and mail with nested parts, encodings and broken ends."""

import struct

from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from inkstream.plans import catalog
from inkstream.sources import files, mail


def test_png_gif_and_unknown():
    assert files.measure("a.PNG", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 70000, 3)) == (70000, 3, "png")
    assert files.measure("a.png", b"GIF87a" + struct.pack("<HH", 5, 6)) == (5, 6, "gif")  # the bytes count, not the name
    assert files.measure("a.svg", b"<svg/>") == (None, None, "svg")
    assert files.measure("a.png", b"") == (None, None, "png")
    assert files.measure("a.mp3", b"ID3") == (None, None, "mp3")


def test_jpeg_steps_over_segments():
    other = b"\xff\xe1" + struct.pack(">H", 2 + 20) + b"\xff\xc0" * 10  # a marker inside another segment
    table = b"\xff\xc4" + struct.pack(">H", 4) + b"ab"
    frame = b"\xff\xff\xc2\x00\x11\x08" + struct.pack(">HH", 480, 640) + b"\x03"
    assert files.measure("a.jpg", b"\xff\xd8" + other + table + frame) == (640, 480, "jpeg")
    assert files.measure("a.jpg", b"\xff\xd8" + other) == (None, None, "jpg")
    assert files.measure("a.jpg", b"\xff\xd8\x00\x01\x02\x03\x04\x05\x06\x07\x08\x09\x0a") == (None, None, "jpg")


def test_webp_kinds():
    head = b"RIFF\0\0\0\0WEBP"
    assert files.measure("a.webp", head + b"VP8X" + b"\0" * 8 + (999).to_bytes(3, "little") + (70_000).to_bytes(3, "little")) == (1000, 70_001, "webp")
    assert files.measure("a.webp", head + b"VP8L" + b"\0" * 4 + b"\x2f" + struct.pack("<I", 319 | 239 << 14)) == (320, 240, "webp")
    assert files.measure("a.webp", head + b"VP8 " + b"\0" * 4 + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 176, 144)) == (176, 144, "webp")


def test_video_takes_the_largest_plausible_size():
    track = lambda w, h: struct.pack(">I", 92) + b"tkhd" + b"\0" * 76 + struct.pack(">II", w << 16, h << 16)
    sample = b"\0\0\0\0avc1" + b"\0" * 24 + struct.pack(">HH", 1280, 720)
    assert files.measure("a.mp4", track(320, 240) + track(1920, 100) + track(99, 99)) == (320, 240, "mp4")
    assert files.measure("a.mov", track(320, 240) + sample) == (1280, 720, "mov")
    assert files.measure("a.mp4", struct.pack(">I", 4000) + b"tkhd") == (None, None, "mp4")


def test_media_audit_of_wide_videos(spark, tmp_path):
    """Pages whose videos are more than four times as wide as high; by itself the reader takes such a shape as implausible."""
    ids = [n for n in range(4, 3000, 7) if (160 + n % 700) / (120 + n % 301) > 4]
    spark.createDataFrame([(n, f"<p>{n}</p>") for n in ids], "page_id long, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    assert ids and spark_rows(catalog.QUERIES["media_audit"](spark, str(tmp_path))) == duck_rows(catalog.ORACLE_SQL["media_audit"], str(tmp_path))
    wide = struct.pack(">I", 92) + b"tkhd" + b"\0" * 76 + struct.pack(">II", 850 << 16, 208 << 16)
    assert files.measure("a.mp4", wide) == (None, None, "mp4")


def test_media_files_reads_folders_and_groups_copies(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 2, 3)
    rows = [("a/b/x.png", png), ("a/y.PNG", png), ("z.gif", b"GIF89a\x01\0\x02\0"), ("note.txt", b"no media")]
    folder = f"file://{tmp_path}/media"
    assert files.write_files(spark.createDataFrame(rows, "path string, content binary"), folder) == 4
    found = files.copies(files.media_files(spark, folder)).select("path", "kind", "width", "height", "copies", "first").orderBy("path").collect()
    assert [tuple(r) for r in found] == [("/a/b/x.png", "image", 2, 3, 2, "/a/b/x.png"), ("/a/y.PNG", "image", 2, 3, 2, "/a/b/x.png"), ("/z.gif", "image", 1, 2, 1, "/z.gif")]


NESTED = b"""From: "Press, Office" <Press@Example.COM>\r
Subject: =?utf-8?q?Caf=C3=A9?= news\r
Content-Type: multipart/mixed; boundary=o\r
\r
--o\r
Content-Type: multipart/related; boundary="i"\r
\r
--i\r
Content-Type: multipart/alternative; boundary=k\r
\r
--k\r
Content-Type: text/plain; charset=iso-8859-1\r
Content-Transfer-Encoding: quoted-printable\r
\r
Ol=E1 =\r
world\r
--k\r
Content-Type: text/html\r
\r
<b>Hello</b>\r
--k--\r
--i--\r
--o\r
Content-Type: text/plain\r
Content-Disposition: attachment; filename="notes.txt"\r
Content-Transfer-Encoding: base64\r
\r
YWJjZGU=\r
--o\r
Content-Disposition: attachment\r
\r
nameless\r
"""


def test_nested_parts_without_an_end_boundary():
    _, sender, address, subject, date, text, html, attached = mail.parse(NESTED)
    assert (sender, address, subject, date) == ("Press, Office", "press@example.com", "Café news", "")
    assert text == "Olá world" and html == "<b>Hello</b>"
    assert attached == [{"filename": "notes.txt", "content_type": "text/plain", "size": 5}]


def test_plain_html_and_broken_mail():
    assert mail.parse(b"From: a@b.example\n\n  Body \n")[1:6] == ("", "a@b.example", "", "", "Body")
    html = mail.parse(b"Content-Type: text/html; charset=nonsense\n\n<p>One<br>two</p>\n<i> three</i>")
    assert html[5] == "One two three" and html[6].startswith("<p>")
    assert mail.parse(b"")[5:] == ("", "", [])
    assert mail.parse(b"Content-Type: multipart/mixed; boundary=x\n\nno part")[5:] == ("", "", [])


def test_mailboxes_and_messages(spark, tmp_path):
    body = b"Subject: one\n\nFrom here on\n>From there\nend"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.mbox").write_bytes(mail.quote(body) + mail.quote(b"Subject: two\n\nx"))
    (tmp_path / "b.eml").write_bytes(NESTED)
    (tmp_path / "skip.txt").write_bytes(b"Subject: no\n\n")
    spark.dataSource.register(mail.MailSource)
    found = spark.read.format("mail").option("groupBytes", 10).load(f"file://{tmp_path}")
    assert found.rdd.getNumPartitions() == 2
    rows = {(r.file, r.position): (r.subject, r.text) for r in found.collect()}
    assert rows == {("b.eml", 0): ("Café news", "Olá world"), ("sub/a.mbox", 0): ("one", "From here on\n>From there\nend"), ("sub/a.mbox", 1): ("two", "x")}
    assert found.select(F.explode("attachments.size")).collect() == [(5,)]


def test_no_mail(spark, tmp_path):
    spark.dataSource.register(mail.MailSource)
    assert spark.read.format("mail").load(f"file://{tmp_path}/none").count() == 0
