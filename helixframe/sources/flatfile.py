"""GenBank, EMBL and SwissProt flat files (S16-S29): records, features and annotations."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from .location import Refused, clean_location, parse_location
from .records import FormatError, lines

FORMATS = ("genbank", "embl", "swiss")
_MONTH = re.compile(r"\d{2}-[A-Z]{3}-\d{4}$")


def split_records(data: bytes | Iterable[bytes]) -> Iterator[list[str]]:
    """The lines of each record, without the // that ends it."""
    held: list[str] = []
    for _, raw in lines(data):
        line = raw.decode("latin-1").rstrip()
        if line == "//":
            if any(held):
                yield held
            held = []
        elif held or line:
            held.append(line)
    if any(held):
        raise FormatError("the last record has no // line")


def _squeeze(text: str) -> str:
    return re.sub(" +", " ", text)


def parse(data: bytes | Iterable[bytes], fmt: str, want: frozenset = frozenset(("features", "annotations"))) -> Iterator[dict]:
    """A dict per record: id, name, description, sequence, features, features_error, annotations, annotations_error.

    features and annotations are read only where wanted; what a record's table holds beyond the grammar is refused
    for that record, with the reason in the error column. Of pieces of a file, a record and a piece are held at a time.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {fmt!r}")
    if isinstance(data, bytes) and data[:2] == b"\x1f\x8b":
        raise FormatError("gzip input is refused for flat files")
    for rows in split_records(data):
        rec = (_genbank if fmt == "genbank" else _embl)(rows, fmt)
        head, block = rec.pop("_head"), rec.pop("_block")
        rec |= {"features": None, "features_error": None, "annotations": None, "annotations_error": None}
        if "features" in want:
            if fmt == "swiss":
                rec["features_error"] = "SwissProt feature tables are not read"
            else:
                try:
                    rec["features"] = features(block, rec["_size"], rec["circular"], rec["stranded"])
                except Refused as e:
                    rec["features_error"] = str(e)
        if "annotations" in want:
            if fmt == "swiss":
                rec["annotations_error"] = "SwissProt headers are not read"
            else:
                try:
                    rec["annotations"] = annotations(head, fmt, rec["facts"])
                except Refused as e:
                    rec["annotations_error"] = str(e)
        rec.pop("_size")
        yield rec


def _residues(rows: list[str], fmt: str) -> str:
    """Residues without columns and counts; GenBank and EMBL are upper-cased, SwissProt keeps case."""
    out = []
    for line in rows:
        if fmt == "genbank":
            if not re.match(r" *\d+ ", line[:10] + " "):
                raise FormatError(f"malformed sequence line {line!r}")
            out.append(line[10:])
        else:
            if not line.startswith("     "):
                raise FormatError(f"malformed sequence line {line!r}")
            out.append(re.sub(r"\s+\d+$", "", line[5:]))
    text = re.sub(r"\s", "", "".join(out))
    return text if fmt == "swiss" else text.upper()


def _version(ident: str, name: str) -> tuple[str, int | None]:
    """Id and the number after its dot."""
    m = re.fullmatch(r"(.+)\.(\d+)", ident)
    return (ident or name, int(m[2]) if m else None)


def _genbank(rows: list[str], fmt: str) -> dict:
    if not rows[0].startswith("LOCUS"):
        raise FormatError("a record should start with LOCUS")
    locus = rows[0].ljust(80)
    facts: dict = {}
    size: int | None = None
    if locus[40:44] in (" bp ", " aa ", " rc "):  # S18: the newer layout
        words = locus[12:40].split()
        name = words[0] if words else ""
        size = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
        facts = {"molecule_type": locus[44:54].strip() or None, "topology": locus[55:63].strip() or None, "data_file_division": locus[64:67].strip() or None}
        date = locus[68:79].strip()
        if _MONTH.match(date):
            facts["date"] = date
        units = locus[41:43]
    else:
        words = rows[0].split()
        name = words[1] if len(words) > 1 else ""
        at = next((i for i, w in enumerate(words) if w in ("bp", "aa") and i), None)
        size = int(words[at - 1]) if at and words[at - 1].isdigit() else None
        facts = {"topology": "circular" if "circular" in words else "linear" if "linear" in words else None, "_old": True}
        units = words[at] if at else "bp"
    head: list[tuple[str, list[str]]] = []
    block: list[str] = []
    seq: list[str] = []
    state = "head"
    for line in rows[1:]:
        word = line[:12].strip()
        if line.startswith("FEATURES"):
            state = "features"
        elif line.startswith("ORIGIN"):
            state = "seq"
        elif line.startswith(("CONTIG", "BASE COUNT", "WGS", "TSA ")):
            state = "skip"
        elif state == "seq":
            if line.strip():
                seq.append(line)
        elif state == "features":
            block.append(line)
        elif state == "head":
            if word:
                head.append((word, [line[12:]]))
            elif head:
                head[-1][1].append(line[12:].rstrip())
    get = {k: v for k, v in reversed(head)}
    ident = (get.get("VERSION", [""])[0].split() or [""])[0] or (get.get("ACCESSION", [""])[0].split() or [""])[0]
    description = _squeeze(" ".join(x.strip() for x in get.get("DEFINITION", [""]))).strip()
    description = description[:-1] if description.endswith(".") else description
    ident, version = _version(ident, name)
    facts["version"] = version
    text = _residues(seq, fmt)
    return {"id": ident, "name": name, "description": description, "sequence": text, "circular": facts.get("topology") == "circular", "stranded": units != "aa", "facts": facts, "_size": size if size is not None else len(text), "_head": head, "_block": block}


def _embl(rows: list[str], fmt: str) -> dict:
    if not rows[0].startswith("ID"):
        raise FormatError("a record should start with ID")
    body = rows[0][5:]
    facts: dict = {}
    name, size, version = "", None, None
    if fmt == "embl" and body.count(";") == 6:  # S19
        f = [x.strip() for x in body.rstrip(".").split(";")]
        name, facts = f[0], {"topology": f[2] or None, "molecule_type": f[3] or None, "data_file_division": f[5] or None}
        if f[1].startswith("SV "):
            version = f[1][3:].strip()
        m = re.match(r"(\d+) ", f[6])
        size = int(m[1]) if m else None
    else:
        name = body.split()[0].rstrip(";") if body.split() else ""
        m = re.search(r"(\d+)\s+(?:BP|AA)\.?$", body)
        size = int(m[1]) if m else None
    head: list[tuple[str, list[str]]] = []
    block: list[str] = []
    seq: list[str] = []
    in_seq = False
    for line in rows[1:]:
        key = line[:2]
        if in_seq:
            if line.strip():
                seq.append(line)
        elif key == "SQ":
            in_seq = True
        elif key == "FT":
            block.append("  " + line[2:])
        elif key in ("XX", "  ", "", "FH"):
            continue
        elif key == "CO":
            raise FormatError("a record of CO lines has no sequence to read")
        else:
            if head and head[-1][0] == key and key != "RN":
                head[-1][1].append(line[5:].strip())
            else:
                head.append((key, [line[5:].strip()]))
    get = {k: v for k, v in reversed(head)}
    accession = (get.get("AC", [""])[0].split(";")[0]).strip()
    sv = get.get("SV", [None])[0]
    ident = accession or name
    if sv:
        ident = sv
    elif version and fmt == "embl":
        ident = f"{ident}.{version}"
    if fmt == "swiss":
        ident = accession
    ident, facts["version"] = _version(ident, name)
    text = _residues(seq, fmt)
    return {"id": ident, "name": name, "description": " ".join(get.get("DE", [""])).strip(), "sequence": text, "circular": facts.get("topology") == "circular", "stranded": fmt != "swiss", "facts": facts, "_size": size if size is not None else len(text), "_head": head, "_block": block}


# ------------------------------------------------------------------ features


def features(block: list[str], size: int, circular: bool, stranded: bool) -> list[dict]:
    """The features of a table block; an oddly shaped table is refused as a whole."""
    out: list[dict] = []
    current: list[str] | None = None
    kinds: list[tuple[str, list[str]]] = []
    for line in block:
        if not line.strip():
            continue
        if line[:5] == "     " and line[5:6].strip():
            current = [line[21:].strip()]
            kinds.append((line[5:20].strip() or line.split()[0], current))
        elif line[:21].strip() == "" and current is not None:
            current.append(line[21:].rstrip())
        else:
            raise Refused("feature table: a line that is neither a feature nor its continuation")
    for kind, rows in kinds:
        place, i = rows[0], 1
        if not place:
            raise Refused("feature table: the feature has no location line")
        while i < len(rows) and not rows[i].startswith("/") and (place.count("(") > place.count(")") or place.endswith(",")):
            place += rows[i].strip()
            i += 1
        if place.endswith(","):
            raise Refused("feature table: the location ends in a comma that no line follows")
        qualifiers = []
        while i < len(rows):
            line = rows[i]
            i += 1
            if not line.startswith("/"):
                raise Refused("feature table: text between qualifiers")
            key, eq, value = line[1:].partition("=")
            if eq and value.startswith('"'):
                parts = [value]
                while not _closed("\n".join(parts)):
                    if i >= len(rows):
                        raise Refused("feature table: a quoted value that no line closes")
                    parts.append(rows[i])
                    i += 1
                value = "\n".join(parts)[1:-1].replace('""', '"')
                value = re.sub(r"\s", "", value) if key == "translation" else value.replace("\n", " ")
            qualifiers.append({"key": key, "value": value if eq else "", "has_value": bool(eq), "escape_warning": '"' in value and '""' not in line and eq != "" and value.count('"') % 2 == 1, "escape_text": ""})
        loc = parse_location(clean_location(place), size, circular, stranded)
        out.append({"type": kind, "location": None if loc["status"] != "ok" else {"operator": loc["operator"], "parts": loc["parts"]}, "status": loc["status"], "message": loc["message"], "warnings": loc["warnings"], "qualifiers": qualifiers})
    return out


def _closed(value: str) -> bool:
    """Whether a quoted value ends here: an odd run of quotes at the end that is not the opening one alone."""
    tail = len(value) - len(value.rstrip('"'))
    return tail % 2 == 1 and len(value) > 1 if len(value) != tail else len(value) % 2 == 0


# ------------------------------------------------------------------ annotations


def _ranges(text: str, size_word: str = "bases") -> list[dict]:
    m = re.search(rf"\((?:{size_word}|residues|sites) ?([^)]*)\)", text)
    if not m:
        return []
    out = []
    for piece in m[1].split(";"):
        if not piece.strip() or text.strip().endswith("(sites)"):
            continue
        a, to, b = piece.partition(" to ")
        if not to:
            raise Refused("reference location without a 'to' in it")
        if not (a.strip().isdigit() and b.strip().isdigit()):
            raise Refused("reference location is not two integers")
        out.append({"start": int(a) - 1, "end": int(b)})
    return out


def _reference() -> dict:
    return {"title": "", "authors": "", "consrtm": "", "journal": "", "pubmed_id": "", "medline_id": "", "comment": "", "location": []}


def _put(out: dict, key: str, value) -> None:
    if key not in out:
        out["key_order"].append(key)
    out[key] = value


def _words(text: str, sep: str = ";") -> list[str]:
    return [w.strip() for w in text.rstrip(".").split(sep)]


def annotations(head: list[tuple[str, list[str]]], fmt: str, facts: dict) -> dict:
    """Header keys in order of appearance; a key that is absent is not the same as an empty one."""
    out: dict = {"key_order": []}
    if facts.get("_old"):
        raise Refused("this record's first line is not in a layout this reader takes facts from")
    for key in ("molecule_type", "topology", "data_file_division", "date"):
        if facts.get(key):
            _put(out, key, facts[key])
    (_genbank_head if fmt == "genbank" else _embl_head)(head, out)
    return out


def _genbank_head(head: list, out: dict) -> None:
    for word, rows in head:
        text = _squeeze(" ".join(r.strip() for r in rows)).strip()
        ref = out["references"][-1] if out.get("references") else None
        if word in ("NID", "PID", "DBSOURCE", "SEGMENT"):
            raise Refused(f"{word} lines are not read")
        if word == "ACCESSION":
            _put(out, "accessions", out.get("accessions", []) + [w for w in text.split() if w])
        elif word == "VERSION":
            m = re.match(r"\S+?\.(\d+)(?:\s|$)", text)
            if m:
                _put(out, "sequence_version", int(m[1]))
            if "GI:" in text:
                _put(out, "gi", text.split("GI:")[1].split()[0])
        elif word == "KEYWORDS":
            _put(out, "keywords", _words(text))
        elif word == "SOURCE":
            _put(out, "source", text[:-1] if text.endswith(".") else text)
        elif word == "ORGANISM":
            lines_ = [r.strip() for r in rows]
            cut = next((i for i, r in enumerate(lines_) if i and (";" in r or r.endswith("."))), len(lines_))
            _put(out, "organism", " ".join(lines_[:cut]))
            _put(out, "taxonomy", [w for w in _words(" ".join(lines_[cut:])) if w])
        elif word == "COMMENT":
            if any("-START##" in r for r in rows):
                raise Refused("structured comments are not read")
            _put(out, "comment", "\n".join([*([out["comment"]] if "comment" in out else []), *(r.rstrip() for r in rows)]))
        elif word == "REFERENCE":
            new = _reference() | {"location": _ranges(text)}
            _put(out, "references", out.get("references", []) + [new])
        elif ref is not None:
            field = {"AUTHORS": "authors", "CONSRTM": "consrtm", "TITLE": "title", "JOURNAL": "journal", "MEDLINE": "medline_id", "PUBMED": "pubmed_id", "REMARK": "comment"}.get(word)
            if field:
                ref[field] = text


def _embl_head(head: list, out: dict) -> None:
    for key, rows in head:
        text = _squeeze(" ".join(r for r in rows if r)).strip()
        ref = out["references"][-1] if out.get("references") else None
        if key == "AC":
            _put(out, "accessions", out.get("accessions", []) + [w for w in _words(text) if w])
        elif key == "SV":
            m = re.fullmatch(r".*\.(\d+)", text)
            if m:
                _put(out, "sequence_version", int(m[1]))
        elif key == "KW":
            _put(out, "keywords", _words(text))
        elif key == "OS":
            _put(out, "organism", text)
        elif key == "OC":
            _put(out, "taxonomy", [w for w in _words(text) if w])
        elif key == "CC":
            _put(out, "comment", "\n".join([*([out["comment"]] if "comment" in out else []), *rows]))
        elif key == "RN":
            _put(out, "references", out.get("references", []) + [_reference()])
        elif ref is not None:
            if key == "RP":
                for piece in text.split(","):
                    a, dash, b = piece.strip().partition("-")
                    if not dash or not (a.isdigit() and b.isdigit()):
                        raise Refused("reference location is not two integers")
                    ref["location"].append({"start": int(a) - 1, "end": int(b)})
            elif key == "RX":
                if ";" not in text:
                    raise Refused("an RX line with no ';' in it")
                kind, value = (x.strip() for x in text.split(";", 1))
                field = {"PUBMED": "pubmed_id", "MEDLINE": "medline_id"}.get(kind.upper())
                if field:
                    ref[field] = value.rstrip(".")
            elif key in ("RA", "RG", "RT", "RL"):
                field = {"RA": "authors", "RG": "consrtm", "RT": "title", "RL": "journal"}[key]
                value = text.rstrip(";")
                ref[field] = value.strip('"') if key == "RT" else value
