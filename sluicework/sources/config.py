"""Issues, settings and overrides: read on the driver, checked as a whole, every fault reported."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

#: Names that some systems keep for devices (fixed values).
RESERVED = frozenset({"con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))})
#: Metadata of an issue and the fields of a revision (fixed values).
ISSUE_FIELDS = ("document", "title", "project", "client", "area", "revision", "date")
REVISION_FIELDS = ("revision", "date", "description", "author", "checker", "approver")
ROUTES, EXTRAS = ("A", "B", "C", "D", "E"), ("F", "G")
OVERRIDE_KEYS = frozenset({"rota", "extras", "idioma_ocr", "status", "idioma", "titulo", "codigo", "perfil", "limpeza_extra", "tabelas"})


def identifier(value: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,79}", value) or value.lower() in RESERVED:
        raise ValueError(f"illegal identifier: {value!r}")
    return value


@dataclass(frozen=True)
class Issue:
    fields: dict[str, str]
    page: int
    revisions: tuple[dict[str, str], ...]
    paths: dict[str, str]


def issue(content: bytes | str, folder: str = "", fields: tuple[str, ...] = ISSUE_FIELDS, paths: tuple[str, ...] = ("catalog", "items", "images")) -> Issue:
    """An issue's JSON: required texts, an identifier, a positive first page, whole revisions of which the last is the current one."""
    text = content.decode("utf-8-sig") if isinstance(content, bytes) else content.lstrip("﻿")
    d = json.loads(text)
    if not isinstance(d, dict):
        raise ValueError("an issue is an object")
    got = {}
    for f in fields:
        if not isinstance(d.get(f), str) or not d[f].strip():
            raise ValueError(f"{f} is missing")
        got[f] = d[f].strip()
    identifier(got[fields[0]])
    page = d.get("page", 1)
    if isinstance(page, bool) or not isinstance(page, int) or page < 1:
        raise ValueError("page must be a positive whole number")
    revisions = d.get("revisions")
    if not isinstance(revisions, list) or not revisions:
        raise ValueError("revisions are missing")
    for i, r in enumerate(revisions, 1):
        wrong = [f for f in REVISION_FIELDS if not isinstance(r, dict) or not isinstance(r.get(f), str) or not r[f].strip()]
        if wrong:
            raise ValueError(f"revision {i}: {', '.join(wrong)} missing")
    if revisions[-1]["revision"].strip() != got["revision"]:
        raise ValueError("the last revision is not the current one")
    return Issue(got, page, tuple({f: r[f].strip() for f in REVISION_FIELDS} for r in revisions), {p: str(PurePosixPath(folder) / d[p]) for p in paths if isinstance(d.get(p), str)})


def merge(base: dict, own: dict) -> dict:
    """own over base, table by table; keys that base does not know stay."""
    out = dict(base)
    for k, v in own.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def check_settings(s: dict, ranges: dict[str, tuple[float, float]], choices: dict[str, tuple], unique: tuple[str, ...] = ()) -> list[str]:
    """Faults of settings by dotted names: out of range, not among the choices, repeated."""
    def at(name: str):
        v = s
        for k in name.split("."):
            v = v.get(k) if isinstance(v, dict) else None
        return v

    out = [f"{n} is out of range" for n, (lo, hi) in ranges.items() if not isinstance(at(n), (int, float)) or isinstance(at(n), bool) or not lo <= at(n) <= hi]
    out += [f"{n} is not one of {', '.join(map(str, c))}" for n, c in choices.items() if at(n) not in c]
    return out + [f"{n} has repeated values" for n in unique if len(set(at(n) or [])) != len(at(n) or [])]


def overrides(spark: SparkSession, text: str) -> tuple[DataFrame, list[str]]:
    """((id, route, extras, language, status) rows, warnings) of an overrides file; all faults in one error."""
    faults, warnings, rows = [], [], []
    for key, o in tomllib.loads(text).items():
        if not isinstance(o, dict):
            faults.append(f"{key}: not a table")
            continue
        nested = [k for k, v in o.items() if isinstance(v, dict) and k != "tabelas"]
        faults += [f"{key}.{k}: quote ids that hold dots" for k in nested]
        warnings += [f"{key}.{k}: unknown key" for k in o if k not in OVERRIDE_KEYS and k not in nested]
        if o.get("rota") not in (None, *ROUTES):
            faults.append(f"{key}: route {o['rota']!r}")
        faults += [f"{key}: extra {e!r}" for e in o.get("extras", []) if e not in EXTRAS]
        if "idioma_ocr" in o and not re.fullmatch(r"[a-z]{3}(\+[a-z]{3})*", o["idioma_ocr"]):
            faults.append(f"{key}: language {o['idioma_ocr']!r}")
        rows.append((key, o.get("rota") or "", "+".join(map(str, o.get("extras", []))), o.get("idioma_ocr") or "", o.get("status") or ""))
    if faults:
        raise ValueError("; ".join(faults))
    return spark.createDataFrame(rows, "id string, route string, extras string, language string, status string"), warnings


def safe_output(source: str, output: str) -> None:
    """An output may not lie in its source, nor be it."""
    a, b = PurePosixPath(source), PurePosixPath(output)
    if a == b or a in b.parents:
        raise ValueError(f"{output} lies in {source}")


#: Keys of a configuration with their defaults, by table (fixed values), and the devices that may be named.
DEFAULTS = {"paths": {"input": None, "output": None, "overrides": None}, "run": {"profile": "standard", "jobs": 0, "timeout": 300, "extensions": [".pdf"], "device": "auto"}, "limits": {"disk_gb": 5.0, "accuracy": 80.0}, "tools": {}}
DEVICES = ("auto", "cpu", "cuda")


def layered(text: str | None, folder: str = "", options: dict[str, dict] | None = None, required: bool = True, nearby: tuple[tuple[str, ...], ...] = ()) -> dict:
    """Defaults, a file's values over them and options over those. Paths of the file are relative to its folder.

    nearby: names in the input folder and beside it, in that order, among which an overrides file is found if none is named; several in one folder are an error.
    """
    found = merge(DEFAULTS, tomllib.loads(text) if text else {})
    for k, v in found["paths"].items():
        if v:
            found["paths"][k] = str(PurePosixPath(folder) / v)
    found = merge(found, {t: {k: v for k, v in o.items() if v is not None} for t, o in (options or {}).items()})
    run = found["run"]
    run["extensions"] = [e.lower() for e in run["extensions"]]
    run["device"] = str(run["device"]).lower()
    if run["device"] not in DEVICES:
        raise ValueError(f"device {run['device']!r} is not one of {', '.join(DEVICES)}")
    paths = found["paths"]
    if required:
        for k in ("input", "output"):
            if not paths[k]:
                raise ValueError(f"no {k} folder")
        safe_output(paths["input"], paths["output"])
    if not paths["overrides"]:
        for names in nearby:
            held = sorted(n for n in names if re.fullmatch(r"(.*/)?overrides[^/]*\.toml", n))
            if len(held) > 1:
                raise ValueError(f"several overrides: {', '.join(held)}")
            if held:
                paths["overrides"] = held[0]
                break
    return found
