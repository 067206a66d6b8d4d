"""Release: a reproducible archive of the published files, and a check that trusts nothing but the archive."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import tarfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.errors import ReleaseMismatch
from ownergraph.functions import identity as I


def pack(folder: str, names: list[str], target: str, period: str) -> dict[str, str]:
    """Files in name order, without times and owners: the same content gives the same bytes."""
    sums = {}
    for name in sorted(names):
        with open(os.path.join(folder, name), "rb") as f:
            sums[name] = hashlib.sha256(f.read()).hexdigest()
    listing = json.dumps({"competencia": period, "arquivos": sums}, sort_keys=True, indent=1).encode()
    with open(target, "wb") as raw, gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) as z, tarfile.open(fileobj=z, mode="w") as tar:
        for name, content in [("manifesto.json", listing), *((n, None) for n in sorted(names))]:
            info = tarfile.TarInfo(name)
            info.size = len(content) if content is not None else os.path.getsize(os.path.join(folder, name))
            if content is not None:
                tar.addfile(info, io.BytesIO(content))
            else:
                with open(os.path.join(folder, name), "rb") as f:
                    tar.addfile(info, f)
    return sums


def verify(archive: str, names: list[str], period: str) -> None:
    """Exactly the announced files, their digests, and the period."""
    with tarfile.open(archive, "r:gz") as tar:
        there = tar.getnames()
        if sorted(there) != sorted([*names, "manifesto.json"]):
            raise ReleaseMismatch(f"files differ: {sorted(set(there) ^ {*names, 'manifesto.json'})}")
        manifest = json.load(tar.extractfile("manifesto.json"))
        if manifest["competencia"] != period:
            raise ReleaseMismatch(f"period {manifest['competencia']}, not {period}")
        for name in names:
            found = hashlib.sha256(tar.extractfile(name).read()).hexdigest()
            if found != manifest["arquivos"].get(name):
                raise ReleaseMismatch(f"{name}: another digest than announced")


def named_persons(nodes: DataFrame) -> DataFrame:
    """``n``: people and foreigners whose name or mask would be published; must be 0."""
    people = F.col("tipo").isin(I.PERSON, I.FOREIGNER)
    return nodes.agg(F.count_if(people & (F.col("nome").isNotNull() | F.col("cpf_mascarado").isNotNull() | F.col("identificador").isNotNull())).alias("n"))
