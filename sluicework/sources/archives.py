"""Projects and extractions as archives: one zip of JSON and images each."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from io import BytesIO

VERSION = 1
_DATE = (1980, 1, 1, 0, 0, 0)


def _put(z: zipfile.ZipFile, name: str, data: bytes) -> None:
    z.writestr(zipfile.ZipInfo(name, _DATE), data, zipfile.ZIP_DEFLATED)


def save_project(project: dict) -> bytes:
    """project: {curves: [{id, name, points, axes, locked, page}], main, pages: {id: bytes}}; every curve must be locked."""
    if not all(c.get("locked") for c in project["curves"]):
        raise ValueError("a curve is not locked")
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        _put(z, "project.json", json.dumps({"version": VERSION, "main": project.get("main"), "curves": project["curves"]}, ensure_ascii=False, sort_keys=True).encode())
        for k, data in sorted(project.get("pages", {}).items()):
            _put(z, f"pages/{k}", data)
    return out.getvalue()


def load_project(content: bytes) -> dict:
    with zipfile.ZipFile(BytesIO(content)) as z:
        d = json.loads(z.read("project.json"))
        if d.get("version") != VERSION:
            raise ValueError(f"version {d.get('version')!r}")
        pages = {n[6:]: z.read(n) for n in z.namelist() if n.startswith("pages/")}
    ids = [c["id"] for c in d["curves"]]
    if len(set(ids)) != len(ids):
        raise ValueError("curve ids repeat")
    if d["main"] is not None and d["main"] not in ids:
        raise ValueError("the main curve is missing")
    for c in d["curves"]:
        if len(c["axes"]) != 3 or c["page"] not in pages:
            raise ValueError(f"curve {c['id']}: needs three axis points and its page")
        c["locked"] = True
    return {"curves": d["curves"], "main": d["main"], "pages": pages}


def archive_name(title: str, sha: str) -> str:
    return f"{(re.sub(r'[^\w-]+', '_', title).strip('_')[:80]) or 'document'}_{sha[:12]}.zip"


def append_extractions(content: bytes | None, page: bytes, curves: list[dict]) -> bytes:
    """An extraction archive with curves added: what it holds is never changed, a page is kept once; a page of the same name with other bytes is an error."""
    sha = hashlib.sha256(page).hexdigest()
    held: dict[str, bytes] = {}
    if content:
        with zipfile.ZipFile(BytesIO(content)) as z:
            held = {n: z.read(n) for n in z.namelist()}
    name = f"pages/{sha[:16]}"
    if name in held and held[name] != page:
        raise ValueError("another page has this name")
    held.setdefault(name, page)
    first = sum(n.startswith("curves/") for n in held)
    for i, c in enumerate(curves, first):
        held[f"curves/{i:06d}.json"] = json.dumps({**c, "page": sha}, ensure_ascii=False, sort_keys=True).encode()
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in sorted(held):
            _put(z, n, held[n])
    return out.getvalue()
