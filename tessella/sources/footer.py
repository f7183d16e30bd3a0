"""Parquet footers as frames: file, root fields, row groups, column chunks. Executors read footers only."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "file": "file string, num_rows long, created_by string, num_row_groups long, num_columns long, format_version string, key_value_metadata map<string,string>",
    "fields": "file string, position long, name string, type string, physical_type string, type_length long, scale long, precision long, repetition string, converted_type string, logical_type string",
    "row_groups": "file string, ordinal long, num_columns long, num_rows long, total_byte_size long, file_offset long, compressed_size long",
    "chunks": "file string, row_group long, position long, column_path string, file_path string, file_offset long, has_offset_index boolean, has_column_index boolean, physical_type string, compression string, num_values long, total_compressed_size long, total_uncompressed_size long, data_page_offset long, dictionary_page_offset long, encodings array<string>, null_count long, distinct_count long, min string, max string",
}


def _open(path: str) -> pq.ParquetFile:
    if path.startswith("file:"):
        return pq.ParquetFile("/" + path[5:].lstrip("/"))
    if "://" in path:
        system, inner = pafs.FileSystem.from_uri(path)
        return pq.ParquetFile(system.open_input_file(inner))
    return pq.ParquetFile(path)


def _rows(path: str, what: str) -> list[dict]:
    with _open(path) as f:
        m, schema, arrow = f.metadata, f.schema, f.schema_arrow
        groups = [m.row_group(i) for i in range(m.num_row_groups)]
        if what == "file":
            return [{"file": path, "num_rows": m.num_rows, "created_by": m.created_by, "num_row_groups": m.num_row_groups, "num_columns": m.num_columns, "format_version": m.format_version, "key_value_metadata": [(k.decode(errors="replace"), v.decode(errors="replace")) for k, v in (m.metadata or {}).items()]}]
        if what == "fields":
            leaf = {schema.column(i).path: schema.column(i) for i in range(len(schema))}
            out = []
            for i, field in enumerate(arrow):
                c = leaf.get(field.name)
                logical = json.loads(c.logical_type.to_json()) if c is not None else {}
                out.append({"file": path, "position": i, "name": field.name, "type": "group" if c is None else "primitive", "physical_type": c and c.physical_type, "type_length": c and (c.length or None), "scale": c and (c.scale if c.precision > 0 else None), "precision": c and (c.precision if c.precision > 0 else None), "repetition": "OPTIONAL" if field.nullable else "REQUIRED", "converted_type": c and (None if c.converted_type == "NONE" else c.converted_type), "logical_type": None if logical.get("Type", "None") == "None" else json.dumps(logical, sort_keys=True)})
            return out
        if what == "row_groups":
            out = []
            for i, g in enumerate(groups):
                cols = [g.column(j) for j in range(g.num_columns)]
                first = min((c.dictionary_page_offset or c.data_page_offset for c in cols), default=None)
                out.append({"file": path, "ordinal": i, "num_columns": g.num_columns, "num_rows": g.num_rows, "total_byte_size": g.total_byte_size, "file_offset": first, "compressed_size": sum(c.total_compressed_size for c in cols)})
            return out
        out = []
        for i, g in enumerate(groups):
            for j in range(g.num_columns):
                c = g.column(j)
                s = c.statistics if c.is_stats_set else None
                bound = lambda k, s=s: str(getattr(s, k)) if s is not None and s.has_min_max else None
                out.append({"file": path, "row_group": i, "position": j, "column_path": c.path_in_schema, "file_path": c.file_path or None, "file_offset": c.file_offset, "has_offset_index": c.has_offset_index, "has_column_index": c.has_column_index, "physical_type": c.physical_type, "compression": c.compression, "num_values": c.num_values, "total_compressed_size": c.total_compressed_size, "total_uncompressed_size": c.total_uncompressed_size, "data_page_offset": c.data_page_offset, "dictionary_page_offset": c.dictionary_page_offset, "encodings": list(c.encodings), "null_count": s.null_count if s is not None and s.has_null_count else None, "distinct_count": s.distinct_count if s is not None and s.has_distinct_count else None, "min": bound("min"), "max": bound("max")})
        return out


def footers(spark: SparkSession, path: str, what: str = "file") -> DataFrame:
    """One of ``SCHEMAS`` over every file at ``path``; the listing is Spark's, and files are dealt to executors."""
    schema = SCHEMAS[what]
    names = [x.split()[0] for x in schema.split(", ")]
    files = spark.read.format("binaryFile").load(path).select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}
        for b in batches:
            for p in b.column(0).to_pylist():
                rows = _rows(p, what)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)], names)

    return files.mapInArrow(read, schema).withColumn("file", F.regexp_replace("file", "^file:/+", "/"))
