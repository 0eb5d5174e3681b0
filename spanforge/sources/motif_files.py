"""Motif files: weight tables, JASPAR, and MEME or DREME XML. Small, so they are read on the driver."""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET
from pathlib import Path

from ..operators.motifs import Matrix, frequencies_to_weights, smoothed


def _text(path: str) -> str:
    raw = Path(path).read_bytes()
    return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode()


def read_matrix(path: str) -> Matrix:
    """A row a base: the base and its weights."""
    values: dict[str, list[float]] = {}
    for line in _text(path).splitlines():
        f = line.split()
        if f:
            if len(f) < 2 or f[0].lower() not in "acgt" or values and len(f) - 1 != len(next(iter(values.values()))):
                raise ValueError("invalid matrix")
            values[f[0].lower()] = [float(x) for x in f[1:]]
    if set(values) != set("acgt"):
        raise ValueError("matrix lacks a base")
    return Matrix(values)


def write_matrix(m: Matrix, path: str) -> None:
    Path(path).write_text("".join(f"{b.upper()} " + " ".join(f"{x:.6f}" for x in m.values[b]) + "\n" for b in "acgt"))


def write_jaspar(m: Matrix, path: str, name: str = "") -> None:
    body = "".join(f"{b.upper()} [ " + " ".join(f"{x:.6f}" for x in m.values[b]) + " ]\n" for b in "acgt")
    Path(path).write_text((f">{name}\n" if name else "") + body)


def read_meme(path: str) -> tuple[list[dict], list[float]]:
    """Motifs (id, name, frequencies by position in the order a, c, g, t) and background of a MEME or DREME file."""
    root = ET.fromstring(_text(path))
    motifs = []
    if root.tag == "MEME":
        letters = {x.get("id"): x.get("symbol") for x in root.findall("./training_set/alphabet/letter")}
        of = lambda arr: {letters.get(v.get("letter_id"), v.get("letter_id", "")[-1:]).lower(): float(v.text) for v in arr.findall(".//value")}
        background = of(root.find("./model/background_frequencies/alphabet_array"))
        for m in root.findall("./motifs/motif"):
            rows = [of(a) for a in m.findall("./probabilities/alphabet_matrix/alphabet_array")]
            motifs.append({"id": m.get("id"), "name": m.get("name"), "frequencies": [[r[b] for b in "acgt"] for r in rows]})
    elif root.tag == "dreme":
        bg = root.find("./model/background")
        background = {b: float(bg.get(b.upper())) for b in "acgt"}
        for m in root.findall("./motifs/motif"):
            motifs.append({"id": m.get("id"), "name": m.get("seq"), "frequencies": [[float(p.get(b.upper())) for b in "acgt"] for p in m.findall("pos")]})
    else:
        raise ValueError(f"neither MEME nor DREME: {root.tag}")
    return motifs, [background[b] for b in "acgt"]


def motif_matrices(path: str, kind: str = "pwm", alpha: float = 0.0, names: list[str] | None = None) -> dict[str, Matrix]:
    """Motifs of an XML file as weights (``pwm``) or smoothed frequencies (``ppm``)."""
    motifs, background = read_meme(path)
    out = {}
    for m in motifs:
        if names and m["name"] not in names and m["id"] not in names:
            continue
        rows = frequencies_to_weights(m["frequencies"], background, alpha) if kind == "pwm" else [smoothed(r, alpha) for r in m["frequencies"]]
        out[m["name"]] = Matrix({b: [r[i] for r in rows] for i, b in enumerate("acgt")})
    return out
