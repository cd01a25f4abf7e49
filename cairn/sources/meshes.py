"""PLY and GLB meshes."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cairn.sources.binary import decode_files, read_files

# Numbers of the public formats.
_TYPES = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}
GLTF, JSON_CHUNK, BIN_CHUNK = b"glTF", b"JSON", b"BIN\0"
FLOAT, UINT32 = 5126, 5125


def encode_ply(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """A binary little-endian PLY of float vertices and triangles."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    f = np.zeros(len(faces), [("n", "u1"), ("v", "<i4", 3)])
    f["n"], f["v"] = 3, faces.reshape(-1, 3)
    return head.encode() + vertices.astype("<f4").tobytes() + f.tobytes()


def decode_ply(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (n, 3) and triangles (m, 3); polygons become fans around their first corner. Binary and ASCII."""
    end = content.index(b"end_header\n") + 11
    ascii_, elements = False, []
    for line in content[:end].decode().splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            ascii_ = w[1] == "ascii"
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(w[1:])
    vertices, triangles = np.zeros((0, 3)), []
    tokens, at = (content[end:].split() if ascii_ else None), 0 if ascii_ else end
    for name, count, props in elements:
        if any(p[0] == "list" for p in props):
            for _ in range(count):
                for p in props:
                    if p[0] != "list":
                        at += 1 if ascii_ else np.dtype(_TYPES[p[0]]).itemsize
                        continue
                    if ascii_:
                        n = int(tokens[at])
                        ring = [int(t) for t in tokens[at + 1 : at + 1 + n]]
                        at += 1 + n
                    else:
                        size, item = np.dtype(_TYPES[p[1]]), np.dtype(_TYPES[p[2]])
                        n = int(np.frombuffer(content, size, 1, at)[0])
                        ring = np.frombuffer(content, item, n, at + size.itemsize).tolist()
                        at += size.itemsize + n * item.itemsize
                    if name == "face" and p[3] in ("vertex_indices", "vertex_index"):
                        triangles += [(ring[0], ring[k], ring[k + 1]) for k in range(1, n - 1)]
            continue
        if ascii_:
            table = np.array(tokens[at : at + count * len(props)], float).reshape(count, len(props))
            columns, at = {p[1]: table[:, i] for i, p in enumerate(props)}, at + count * len(props)
        else:
            kind = np.dtype([(p[1], _TYPES[p[0]]) for p in props])
            table = np.frombuffer(content, kind, count, at)
            columns, at = {p[1]: table[p[1]] for p in props}, at + count * kind.itemsize
        if name == "vertex":
            vertices = np.stack([columns[k].astype(float) for k in "xyz"], 1)
    return vertices, np.array(triangles, np.int64).reshape(-1, 3)


def encode_glb(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """A binary glTF of one triangle mesh, positions turned to y up (x, z, -y), accessors with their extent."""
    p = vertices[:, [0, 2, 1]].astype("<f4") * np.array([1, 1, -1], "<f4")
    i = faces.astype("<u4").ravel()
    body = p.tobytes() + i.tobytes()
    low, high = (p.min(0).tolist(), p.max(0).tolist()) if len(p) else ([0.0] * 3, [0.0] * 3)
    doc = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "accessors": [{"bufferView": 0, "componentType": FLOAT, "count": len(p), "type": "VEC3", "min": low, "max": high}, {"bufferView": 1, "componentType": UINT32, "count": len(i), "type": "SCALAR"}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": p.nbytes}, {"buffer": 0, "byteOffset": p.nbytes, "byteLength": i.nbytes}], "buffers": [{"byteLength": len(body)}],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body += b"\0" * (-len(body) % 4)
    chunk = lambda kind, data: struct.pack("<I", len(data)) + kind + data
    chunks = chunk(JSON_CHUNK, text) + chunk(BIN_CHUNK, body)
    return GLTF + struct.pack("<II", 2, 12 + len(chunks)) + chunks


def glb_document(content: bytes) -> dict | None:
    if content[:4] != GLTF:
        return None
    (n,) = struct.unpack_from("<I", content, 12)
    return json.loads(content[20 : 20 + n])


def glb_heights(content: bytes) -> tuple[float, float] | None:
    """Lowest and highest y of all position accessors; None if the file isn't a binary glTF."""
    doc = glb_document(content)
    if doc is None:
        return None
    ids = {p["attributes"]["POSITION"] for m in doc.get("meshes", []) for p in m["primitives"]}
    boxes = [(doc["accessors"][i]["min"][1], doc["accessors"][i]["max"][1]) for i in ids]
    return (min(b[0] for b in boxes), max(b[1] for b in boxes)) if boxes else None


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (path, vid, x, y, z) and faces (path, fid, a, b, c) of all PLY files."""
    files = read_files(spark, path, "*.ply")

    def vertices(name, content):
        v, _ = decode_ply(content)
        yield pd.DataFrame({"path": name, "vid": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})

    def faces(name, content):
        _, f = decode_ply(content)
        yield pd.DataFrame({"path": name, "fid": np.arange(len(f)), "a": f[:, 0], "b": f[:, 1], "c": f[:, 2]})

    return decode_files(files, vertices, "path string, vid long, x double, y double, z double"), decode_files(files, faces, "path string, fid long, a long, b long, c long")


def read_glb_heights(spark: SparkSession, path: str) -> DataFrame:
    """path, low, high of each GLB file; nulls where there are no positions."""

    def heights(name, content):
        h = glb_heights(content)
        yield pd.DataFrame({"path": [name], "low": [h[0] if h else None], "high": [h[1] if h else None]}, dtype=object)

    return decode_files(read_files(spark, path, "*.glb"), heights, "path string, low double, high double")


def encode_meshes(faces: DataFrame, key: str, kind: str) -> DataFrame:
    """name, content: one file for each ``key`` of triangles with corners ax ... cz; equal corners are one vertex."""
    encode = {"ply": encode_ply, "glb": encode_glb}[kind]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        p = f[[k + d for k in "abc" for d in "xyz"]].to_numpy(float).reshape(-1, 3)
        v, index = np.unique(p, axis=0, return_inverse=True)
        return pd.DataFrame([{"name": f"{f[key].iloc[0]}.{kind}", "content": encode(v, index.reshape(-1, 3))}])

    return faces.groupBy(key).applyInPandas(run, "name string, content binary")


def quantize(v: np.ndarray, bits: int = 14) -> tuple[np.ndarray, float, float]:
    """Integers of ``bits`` bits over the range of ``v``, with the range's low end and size."""
    low, size = float(v.min()), float(v.max() - v.min()) or 1.0
    return np.rint((v - low) / size * (2**bits - 1)).astype(np.int64), low, size


def write_obj(vertices: DataFrame, faces: DataFrame, root: str) -> None:
    """Vertices (vid from 1) and faces (vertex numbers from 0) as OBJ lines under ``root``, vertices in order first."""
    from pyspark.sql import functions as F

    v = vertices.select(F.lit(0).alias("part"), F.col("vid").alias("n"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line"))
    f = faces.select(F.lit(1).alias("part"), F.col("fid").alias("n"), F.concat_ws(" ", F.lit("f"), *[F.col(k) + 1 for k in "abc"]).alias("line"))
    v.union(f).coalesce(1).sortWithinPartitions("part", "n").select("line").write.text(root)


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (v from 1, x, y, z) and faces (f from 1, a, b, c, numbered from 0) of one OBJ text; a line's place in the
    file numbers it, so a file is read by one task."""
    from pyspark.sql import functions as F

    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line")).select(F.split(F.trim("line"), r"\s+").alias("w"))
    pick = lambda kind: lines.where(F.get("w", F.lit(0)) == kind)
    numbered = lambda df, name: df.select("w", (F.monotonically_increasing_id() + 1).alias(name))
    at = lambda k: F.get("w", F.lit(k))
    vertices = numbered(pick("v"), "v").select("v", *[at(k + 1).cast("double").alias(c) for k, c in enumerate("xyz")])
    faces = numbered(pick("f"), "f").select("f", *[(F.substring_index(at(k + 1), "/", 1).cast("long") - 1).alias(c) for k, c in enumerate("abc")])
    return vertices, faces
