"""File type from content and name. The first rule that fits wins: magic bytes, ELF, Mach-O, shebang, JSON and XML text, extension, plain UTF-8."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

SNIFF = 8192
TYPE = "description string, is_text boolean"
UNREADABLE = ("(unreadable)", False)

#: (offset, magic, mime, extension): a documented subset of public signatures.
_MAGIC = [
    (0, b"\x89PNG\r\n\x1a\n", "image/png", "png"), (0, b"\xff\xd8\xff", "image/jpeg", "jpg"), (0, b"GIF8", "image/gif", "gif"), (0, b"%PDF", "application/pdf", "pdf"),
    (0, b"PK\x03\x04", "application/zip", "zip"), (0, b"\x1f\x8b\x08", "application/gzip", "gz"), (0, b"BZh", "application/x-bzip2", "bz2"), (0, b"\xfd7zXZ\x00", "application/x-xz", "xz"),
    (0, b"\x28\xb5\x2f\xfd", "application/zstd", "zst"), (0, b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed", "7z"), (0, b"SQLite format 3\x00", "application/vnd.sqlite3", "sqlite"),
    (0, b"\x00asm", "application/wasm", "wasm"), (0, b"ID3", "audio/mpeg", "mp3"), (4, b"ftyp", "video/mp4", "mp4"), (8, b"WAVE", "audio/x-wav", "wav"), (0, b"OggS", "audio/ogg", "ogg"),
    (0, b"fLaC", "audio/x-flac", "flac"), (0, b"II*\x00", "image/tiff", "tif"), (0, b"MM\x00*", "image/tiff", "tif"), (257, b"ustar", "application/x-tar", "tar"),
]

_MACHINES = {0x03: "x86", 0x08: "MIPS", 0x14: "PowerPC", 0x15: "PowerPC64", 0x28: "ARM", 0x2A: "SuperH", 0x32: "IA-64", 0x3E: "x86-64", 0xB7: "AArch64", 0xF3: "RISC-V", 0xF7: "BPF"}
_ELF_TYPES = {1: "relocatable", 2: "executable", 3: "shared object", 4: "core dump"}
_MACH = {b"\xcf\xfa\xed\xfe": ("64-bit", "little"), b"\xfe\xed\xfa\xcf": ("64-bit", "big"), b"\xce\xfa\xed\xfe": ("32-bit", "little"), b"\xfe\xed\xfa\xce": ("32-bit", "big")}
_MACH_CPU = {7: "x86", 0x01000007: "x86-64", 12: "ARM", 0x0100000C: "ARM64", 18: "PowerPC", 0x01000012: "PowerPC64"}
_MACH_TYPES = {1: "object", 2: "executable", 3: "fixed VM shared library", 4: "core dump", 5: "preloaded executable", 6: "dylib", 7: "dynamic linker", 8: "bundle"}

_INTERPRETERS = {
    "Bash": "bash", "POSIX shell": "sh", "Zsh": "zsh", "Fish": "fish", "Dash": "dash", "Perl": "perl", "Ruby": "ruby", "Node.js": "node nodejs", "R": "Rscript", "Lua": "lua", "PHP": "php",
    "AWK": "awk gawk mawk", "Sed": "sed", "Tcl": "tclsh wish",
}
_BY_INTERPRETER = {x: f"{name} script" for name, xs in _INTERPRETERS.items() for x in xs.split()}

_KINDS = {
    "text": {"CSV": "csv", "TSV": "tsv", "JSON": "json", "JSON Lines": "jsonl ndjson", "YAML": "yaml yml", "TOML": "toml", "XML": "xml", "HTML": "html htm", "CSS": "css", "Markdown": "md markdown", "LaTeX": "tex latex", "SQL": "sql", "GraphQL": "graphql gql", "Protocol Buffers": "proto", "Configuration": "ini cfg conf", "Plain": "txt text log"},
    "source": {"Python": "py", "Rust": "rs", "C": "c", "C++": "cpp cc cxx", "Java": "java", "Go": "go", "JavaScript": "js mjs cjs", "TypeScript": "ts mts cts", "Ruby": "rb", "Perl": "pl pm", "PHP": "php", "R": "r", "Julia": "jl", "Lua": "lua", "Swift": "swift", "Kotlin": "kt kts", "Scala": "scala", "Haskell": "hs", "OCaml": "ml mli", "Elixir": "ex exs", "Erlang": "erl hrl", "Fortran": "f f90 f95 f03 f08 for"},
    "header": {"C": "h", "C++": "hpp hh hxx"},
    "script": {"Shell": "sh bash", "Zsh": "zsh", "Fish": "fish", "PowerShell": "ps1"},
    "file": {"Environment": "env"},
}
_BY_EXTENSION = {x: f"{name} {kind}" for kind, names in _KINDS.items() for name, xs in names.items() for x in xs.split()} | {"rst": "reStructuredText", "makefile": "Makefile"}


def _elf(b: bytes) -> str:
    if len(b) < 20:
        return "ELF binary"
    order = "little" if b[5] == 1 else "big"
    kind, machine = int.from_bytes(b[16:18], order), int.from_bytes(b[18:20], order)
    return f"ELF {({1: '32-bit', 2: '64-bit'}).get(b[4], 'unknown-class')} {({1: 'LSB', 2: 'MSB'}).get(b[5], 'unknown-endian')} {_ELF_TYPES.get(kind, 'object')}, {_MACHINES.get(machine, 'unknown-arch')}"


def _mach(b: bytes) -> str | None:
    if b[:4] in (b"\xca\xfe\xba\xbe", b"\xbe\xba\xfe\xca"):
        return "Mach-O universal binary"
    if b[:4] not in _MACH:
        return None
    width, order = _MACH[b[:4]]
    kind = _MACH_TYPES.get(int.from_bytes(b[12:16], order), "binary") if len(b) >= 16 else "binary"
    return f"Mach-O {width} {kind}, {_MACH_CPU.get(int.from_bytes(b[4:8], order), 'unknown-arch')}"


def _shebang(b: bytes) -> str | None:
    line = b[2:258].split(b"\n", 1)[0].decode("utf-8", "replace").strip()
    if not line:
        return None
    words = line.split()
    name = words[-1] if "env " in line or "env\t" in line else words[0].rsplit("/", 1)[-1]
    kind = "Python script" if name.startswith("python") else _BY_INTERPRETER.get(name, f"Script (#!{name})")
    return f"{kind}, UTF-8 text"


def _text(b: bytes) -> str | None:
    """UTF-8, but for a character that the end of the sniffed bytes cuts."""
    for cut in range(4):
        try:
            return b[: len(b) - cut].decode("utf-8")
        except UnicodeDecodeError as e:
            if e.start < len(b) - 3 or len(b) < SNIFF:
                return None
    return None


def detect_file_type(content: bytes | None, path: str) -> tuple[str, bool]:
    """(description, is text) of the first bytes of a file."""
    if not content:
        return UNREADABLE
    b = bytes(content[:SNIFF])
    for offset, magic, mime, ext in _MAGIC:
        if b[offset : offset + len(magic)] == magic:
            return f"{mime} ({ext})", False
    if b[:4] == b"\x7fELF":
        return _elf(b), False
    if len(b) >= 8 and (x := _mach(b)):
        return x, False
    if b[:2] == b"#!" and (x := _shebang(b)):
        return x, True
    text = _text(b)
    if text is None:
        return "application/octet-stream (binary data)", False
    head = text.lstrip()
    if head[:1] in ("{", "["):
        return "JSON text, UTF-8", True
    if head.startswith(("<?xml", "<!DOCTYPE")):
        return "XML text, UTF-8", True
    name = path.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return (f"{_BY_EXTENSION[ext]}, UTF-8" if ext in _BY_EXTENSION else "text/plain; UTF-8"), True


@F.pandas_udf(StructType([StructField("description", StringType()), StructField("is_text", BooleanType())]))
def file_type(content: pd.Series, path: pd.Series) -> pd.DataFrame:
    rows = [detect_file_type(c, p or "") for c, p in zip(content, path)]
    return pd.DataFrame(rows, columns=["description", "is_text"])


def sniff(files: DataFrame) -> DataFrame:
    """description and is_text of the files at column ``path``, of which only the first bytes are read."""

    def run(frames):
        for f in frames:
            rows = []
            for p in f["path"]:
                try:
                    with open(os.fsencode(p), "rb") as h:
                        rows.append(detect_file_type(h.read(SNIFF), p))
                except OSError:
                    rows.append(UNREADABLE)
            yield pd.DataFrame({"path": f["path"].tolist(), "description": [r[0] for r in rows], "is_text": [r[1] for r in rows]})

    return files.select("path").mapInPandas(run, f"path string, {TYPE}")


class TextPager:
    """Lines of a text file in chunks, with a sliding window over them; one reader for all chunks."""

    def __init__(self, path: str, chunk: int = 64 << 10, window: int = 100_000):
        self.path, self.chunk, self.window = path, chunk, window
        self.reload()

    def reload(self) -> None:
        self.offset, self.first, self.lines, self.tail, self.done = 0, 0, [], b"", False
        self.more()

    def more(self) -> bool:
        """Load the next chunk; False at the end of the file."""
        if self.done:
            return False
        with open(self.path, "rb") as f:
            f.seek(self.offset)
            data = f.read(self.chunk)
        self.offset += len(data)
        self.done = len(data) < self.chunk
        *whole, self.tail = (self.tail + data).split(b"\n")
        if self.done and self.tail:
            whole, self.tail = [*whole, self.tail], b""
        self.lines += [x.rstrip(b"\r").decode("utf-8", "replace") for x in whole]
        if (over := len(self.lines) - self.window) > 0:
            self.lines, self.first = self.lines[over:], self.first + over
        return True

    def to_end(self) -> None:
        while self.more():
            pass
