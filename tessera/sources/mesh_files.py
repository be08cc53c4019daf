"""Binary mesh files: GLB, 3MF and STL, by extension.

A file is made or read as a whole by one task; many are handled side by side. Places are written in single precision,
as the formats ask for.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import fresh_path

Mesh = tuple[np.ndarray, np.ndarray]

#: Component types and sizes of glTF accessors, names of 3MF parts.
_COMPONENT = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
_WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
_CORE = "http://schemas.microsoft.com/3dmanufacturing/core/2015/02"
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="model" ContentType="application/vnd.ms-package.3dmanufacturing-3dmodel+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Target="/3D/3dmodel.model" Id="rel0" Type="http://schemas.microsoft.com/3dmanufacturing/2013/01/3dmodel"/></Relationships>'


def write_glb(points: np.ndarray, tris: np.ndarray) -> bytes:
    at, index = points.astype("<f4"), tris.astype("<u4")
    body = index.tobytes() + at.tobytes()
    bounds = {"min": at.min(axis=0).tolist(), "max": at.max(axis=0).tolist()} if len(at) else {"min": [0, 0, 0], "max": [0, 0, 0]}
    head = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 1}, "indices": 0}]}], "buffers": [{"byteLength": len(body)}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": index.nbytes, "target": 34963}, {"buffer": 0, "byteOffset": index.nbytes, "byteLength": at.nbytes, "target": 34962}],
        "accessors": [{"bufferView": 0, "componentType": 5125, "count": int(index.size), "type": "SCALAR"}, {"bufferView": 1, "componentType": 5126, "count": len(at), "type": "VEC3", **bounds}],
    }
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 4)
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(body)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + body


def read_glb(data: bytes) -> Mesh:
    """Points and triangles of all primitives, moved by their nodes' translations and scales."""
    magic, version, size = struct.unpack_from("<4sII", data)
    if magic != b"glTF" or version != 2 or size > len(data):
        raise ValueError("not a GLB file of version 2")
    head, body, at = None, b"", 12
    while at < size:
        n, kind = struct.unpack_from("<I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        head, body = (json.loads(chunk), body) if kind == b"JSON" else (head, chunk if kind == b"BIN\0" else body)
        at += 8 + n

    def accessor(k: int) -> np.ndarray:
        a = head["accessors"][k]
        view = head["bufferViews"][a["bufferView"]]
        kind, width = np.dtype(_COMPONENT[a["componentType"]]), _WIDTH[a["type"]]
        start, step = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride", kind.itemsize * width)
        rows = [np.frombuffer(body, kind, width, start + step * i) for i in range(a["count"])] if step != kind.itemsize * width else np.frombuffer(body, kind, width * a["count"], start).reshape(-1, width)
        return np.asarray(rows).reshape(-1, width)

    points, tris, count = [], [], 0
    for node in head.get("nodes", []):
        if "mesh" not in node:
            continue
        for primitive in head["meshes"][node["mesh"]]["primitives"]:
            place = accessor(primitive["attributes"]["POSITION"]).astype(float) * node.get("scale", [1, 1, 1]) + node.get("translation", [0, 0, 0])
            index = accessor(primitive["indices"]).reshape(-1, 3).astype(int) if "indices" in primitive else np.arange(len(place)).reshape(-1, 3)
            points.append(place)
            tris.append(index + count)
            count += len(place)
    return np.vstack(points) if points else np.empty((0, 3)), np.vstack(tris) if tris else np.empty((0, 3), int)


def write_3mf(points: np.ndarray, tris: np.ndarray) -> bytes:
    at = "".join(f'<vertex x="{x!r}" y="{y!r}" z="{z!r}"/>' for x, y, z in points.astype(float).tolist())
    faces = "".join(f'<triangle v1="{a}" v2="{b}" v3="{c}"/>' for a, b, c in tris.tolist())
    model = f'<?xml version="1.0" encoding="UTF-8"?><model unit="millimeter" xmlns="{_CORE}"><resources><object id="1" type="model"><mesh><vertices>{at}</vertices><triangles>{faces}</triangles></mesh></object></resources><build><item objectid="1"/></build></model>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("3D/3dmodel.model", model)):
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def read_3mf(data: bytes) -> Mesh:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("3D/3dmodel.model"))
    points, tris = [], []
    for mesh in root.iter(f"{{{_CORE}}}mesh"):
        start = len(points)
        points += [[float(v.get(c)) for c in "xyz"] for v in mesh.iter(f"{{{_CORE}}}vertex")]
        tris += [[int(t.get(f"v{k}")) + start for k in (1, 2, 3)] for t in mesh.iter(f"{{{_CORE}}}triangle")]
    return np.array(points).reshape(-1, 3), np.array(tris, int).reshape(-1, 3)


_FACET = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("more", "<u2")])


def write_stl(points: np.ndarray, tris: np.ndarray) -> bytes:
    rows = np.zeros(len(tris), _FACET)
    if len(tris):
        at = points[tris]
        n = np.cross(at[:, 1] - at[:, 0], at[:, 2] - at[:, 0])
        size = np.linalg.norm(n, axis=1)[:, None]
        rows["normal"], rows["corners"] = np.divide(n, size, out=np.zeros_like(n), where=size > 0), at
    return b"\0" * 80 + struct.pack("<I", len(tris)) + rows.tobytes()


def read_stl(data: bytes) -> Mesh:
    """Every triangle has corners of its own; ``exchange.merge`` finds those that are one."""
    rows = np.frombuffer(data, _FACET, struct.unpack_from("<I", data, 80)[0], 84)
    return rows["corners"].reshape(-1, 3).astype(float), np.arange(3 * len(rows)).reshape(-1, 3)


READERS: dict[str, Callable[[bytes], Mesh]] = {"glb": read_glb, "3mf": read_3mf, "stl": read_stl}
WRITERS: dict[str, Callable[[np.ndarray, np.ndarray], bytes]] = {"glb": write_glb, "3mf": write_3mf, "stl": write_stl}


def extension(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower()


def supports(name: str) -> bool:
    return extension(name) in READERS


def import_meshes(spark: SparkSession, path: str) -> DataFrame:
    """Records (file, num_prop, vert_properties, tri_verts, status) of all mesh files at ``path`` (a folder, file or
    pattern) that a reader knows; one that cannot be read has the status InvalidConstruction and no triangles."""

    def run(frames):
        for frame in frames:
            rows = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    points, tris = READERS[extension(name)](bytes(data))
                    rows.append((name, 3, points.reshape(-1).tolist(), tris.reshape(-1).tolist(), "NoError"))
                except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile, ElementTree.ParseError):
                    rows.append((name, 3, [], [], "InvalidConstruction"))
            yield pd.DataFrame(rows, columns=["file", "num_prop", "vert_properties", "tri_verts", "status"])

    known = "|".join(READERS)
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(rf"\.({known})$")).select("path", "content")
    return files.mapInPandas(run, "file string, num_prop int, vert_properties array<double>, tri_verts array<long>, status string")


def export_meshes(records: DataFrame, kind: str, folder: str | None = None) -> DataFrame:
    """mesh_id, file, bytes of one file a record (mesh_id, num_prop, vert_properties, tri_verts) below ``folder`` (a new one
    in the shared folder if none is given), which all executors must see."""
    if kind not in WRITERS:
        raise ValueError(f"no writer for {kind}")
    folder = folder or fresh_path(records.sparkSession, "meshes")
    sink, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    sink.create_dir(path, recursive=True)

    def run(frames):
        for frame in frames:
            rows = []
            for mesh_id, n, points, tris in frame.itertuples(index=False):
                at = np.asarray(points, float).reshape(-1, int(n))[:, :3] if len(points) else np.empty((0, 3))
                data = WRITERS[kind](at, np.asarray(tris, int).reshape(-1, 3))
                name = f"{path}/{mesh_id}.{kind}"
                with sink.open_output_stream(name) as out:
                    out.write(data)
                rows.append((mesh_id, name, len(data)))
            yield pd.DataFrame(rows, columns=["mesh_id", "file", "bytes"])

    return records.select("mesh_id", "num_prop", F.col("vert_properties").cast("array<double>"), F.col("tri_verts").cast("array<long>")).mapInPandas(run, "mesh_id long, file string, bytes long")
