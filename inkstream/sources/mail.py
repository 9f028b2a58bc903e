"""Saved mail as a data source: single messages (.eml) and mailboxes (.mbox) below a folder."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from email import policy
from email.message import EmailMessage
from email.parser import BytesParser

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ATTACHMENTS = "attachments array<struct<filename: string, content_type: string, size: bigint>>"
SCHEMA = f"file string, position bigint, message_id string, sender string, address string, subject string, date string, text string, html string, {ATTACHMENTS}"
_ATTACHMENT = pa.struct([("filename", pa.string()), ("content_type", pa.string()), ("size", pa.int64())])
_TEXTS = ("message_id", "sender", "address", "subject", "date", "text", "html")
#: ``SCHEMA`` as Arrow has it.
ARROW = pa.schema([("file", pa.string()), ("position", pa.int64()), *((c, pa.string()) for c in _TEXTS), ("attachments", pa.list_(_ATTACHMENT))])
ADDRESS = re.compile(r"^(.*?)<([^>]+)>$")
GROUP_BYTES = 64 << 20  # bytes of files in a partition; a larger file is one by itself
ROWS = 500
_PARSER = BytesParser(policy=policy.compat32)


def address(line: str) -> tuple[str, str]:
    """Name and address of a From line; a bare address has no name."""
    found = ADDRESS.match(line.strip())
    if found:
        return found[1].strip().strip('"'), found[2].strip().lower()
    return "", line.strip().lower()


def _header(message: EmailMessage, name: str) -> str:
    from email.header import decode_header, make_header

    value = message.get(name)
    if value is None:
        return ""
    try:
        return " ".join(str(make_header(decode_header(str(value)))).split())
    except (LookupError, ValueError):
        return " ".join(str(value).split())


def _text(part: EmailMessage) -> str:
    body = part.get_payload(decode=True) or b""
    try:
        return body.decode(part.get_content_charset() or "utf-8", "replace").strip()
    except LookupError:
        return body.decode("utf-8", "replace").strip()


def parse(raw: bytes) -> tuple:
    """message_id, sender, address, subject, date, text, html and attachments of one message.

    Parts may be nested; of the last plain and the last HTML part that are no attachments come text and html, decoded
    from base64 or quoted-printable. Without a plain part the text is the HTML without its tags. A part that a missing
    end boundary leaves open ends with the message. An attachment counts its decoded bytes.
    """
    message = _PARSER.parsebytes(raw)
    text = html = ""
    attachments = []
    for part in message.walk():
        if part.is_multipart():
            continue
        kind, name = part.get_content_type(), part.get_filename()
        if part.get_content_disposition() == "attachment":
            if name:
                attachments.append({"filename": name, "content_type": kind, "size": len(part.get_payload(decode=True) or b"")})
        elif kind == "text/plain":
            text = _text(part)
        elif kind == "text/html":
            html = _text(part)
    if not text and html:
        text = " ".join(re.sub(r"<[^>]+>", " ", html).split())
    sender, mail = address(_header(message, "From"))
    return _header(message, "Message-ID"), sender, mail, _header(message, "Subject"), _header(message, "Date"), text, html, attachments


def messages(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The messages of a mailbox, one held at a time: each follows a line that begins with ``From ``."""
    held: list[bytes] | None = None
    for line in stream:
        if line.startswith(b"From "):
            if held is not None:
                yield b"".join(held)
            held = []
        elif held is not None:
            held.append(line[1:] if re.match(rb">+From ", line) else line)
    if held is not None:
        yield b"".join(held)


def quote(message: bytes) -> bytes:
    """A message as a mailbox holds it: after a ``From `` line, lines that look like one marked, and an empty line behind."""
    return b"From - Mon Jan  1 00:00:00 2024\n" + re.sub(rb"(?m)^(>*From )", rb">\1", message) + b"\n\n"


@dataclass
class Group(InputPartition):
    files: list[str]


class MailReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.group = int(options.get("groupBytes", GROUP_BYTES))

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".eml", ".mbox")))
        groups: list[Group] = [Group([])]
        size = 0
        for path, own in files:
            if groups[-1].files and size + own > self.group:
                groups.append(Group([]))
                size = 0
            groups[-1].files.append(path)
            size += own
        return groups

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.folder)
        out: list[tuple] = []
        for path in partition.files:
            with store.open_input_stream(path, compression=None) as stream:
                each = messages(_lines(stream)) if path.endswith(".mbox") else [stream.read()]
                for position, raw in enumerate(each):
                    out.append((path.removeprefix(root).lstrip("/"), position, *parse(raw)))
                    if len(out) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)


def _lines(stream: pa.NativeFile, piece: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(piece):
        *lines, rest = (rest + data).split(b"\n")
        for line in lines:
            yield line + b"\n"
    if rest:
        yield rest


class MailSource(DataSource):
    """``spark.read.format("mail").load(folder)`` after ``spark.dataSource.register(MailSource)``.

    One row a message: the file below the folder, the message's place in it, and what ``parse`` gives. A partition is a
    group of files of about ``groupBytes``; a mailbox is read line by line, so only one message is held.
    """

    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MailReader:
        return MailReader(self.options)
