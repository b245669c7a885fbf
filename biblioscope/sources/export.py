"""Exports: the classified corpus, its data dictionary, and a bundle with a manifest."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.scores import CLUSTERS, FLAGS
from .provenance import file_digest

#: The export's columns in order.
COLUMNS = (
    "id", "doi", "periodico_nome", "ano", "cluster_primario_pred", "cluster_certeza", "cluster_secundario_pred",
    *(f"cluster_{c}_prob" for c in CLUSTERS), *(f"{f}_pred" for f in FLAGS), "orientacao_proeminente", "inconclusiva", "epi_certeza",
    *(f"{f}_prob" for f in FLAGS), "cluster_origem", "subpopulacao_juridica", "disciplina_juridica", "modelo_final_cluster", "modelo_final_epi", "data_predicao",
)


def classified(predictions: DataFrame, metadata: DataFrame, key: str = "id", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Predictions with metadata, ordered by key, the export's columns as far as they are there."""
    own = predictions.join(metadata.select(key, *(c for c in metadata.columns if c not in predictions.columns)), key, "left")
    return own.orderBy(key).select(*(c for c in columns if c in own.columns))


def dictionary_rows() -> list[tuple[str, str, str, str]]:
    rows = [("id", "string", "", "identifier of the work"), ("doi", "string", "", "DOI, if it has one"), ("periodico_nome", "string", "", "journal"), ("ano", "int", "2000-2024", "year of publication")]
    rows += [("cluster_primario_pred", "string", "|".join(CLUSTERS), "most probable cluster"), ("cluster_certeza", "double", "0-1", "its probability"), ("cluster_secundario_pred", "string", "|".join(CLUSTERS), "runner-up, if it is close")]
    rows += [(f"cluster_{c}_prob", "double", "0-1", f"probability of cluster {c}") for c in CLUSTERS]
    rows += [(f"{f}_pred", "int", "0|1", f"flag {f}") for f in FLAGS] + [(f"{f}_prob", "double", "0-1", f"probability of {f}") for f in FLAGS]
    rows += [("orientacao_proeminente", "string", "positivista|interpretativa|mixed|nenhuma", "derived from the first axis"), ("inconclusiva", "int", "0|1", "1 if all flags are 0"), ("epi_certeza", "double", "0-1", "mean distance of the flags' probabilities from 0.5")]
    return rows


def dictionary(spark: SparkSession) -> DataFrame:
    """Rows (coluna, tipo, valores, descricao) for the export's columns."""
    return spark.createDataFrame(dictionary_rows(), "coluna string, tipo string, valores string, descricao string")


def bundle(path: str | Path, files: Mapping[str, tuple[str, str]], tables: Mapping[str, tuple[DataFrame, str]] | None = None, tag: str = "") -> list[dict]:
    """A ZIP of files (name -> path, description; absent ones are skipped) and small tables as CSV, with manifest.json of
    digests. Tables are streamed through the driver one partition at a time."""
    import csv
    import hashlib

    manifest, part = [], Path(f"{path}.part")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        for name, (source, text) in files.items():
            if Path(source).exists():
                z.write(source, name)
                manifest.append({"file": name, "sha256": file_digest(source), "description": text})
        for name, (df, text) in (tables or {}).items():
            digest = hashlib.sha256()
            with z.open(name, "w") as f:
                for row in [df.columns, *df.toLocalIterator()]:
                    line = io.StringIO()
                    csv.writer(line).writerow(row)
                    data = line.getvalue().encode()
                    digest.update(data)
                    f.write(data)
            manifest.append({"file": name, "sha256": digest.hexdigest(), "description": text})
        z.writestr("manifest.json", json.dumps({"tag": tag, "files": manifest}, indent=2, ensure_ascii=False))
    os.replace(part, path)
    return manifest
