import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FIELDS = ["entity_id", "business_name", "business_address", "country"]


@pytest.fixture(scope="session")
def split(tmp_path_factory):
    """240 companies; each third has no target, the others one or two, spelt in other ways."""
    rng, folder = random.Random(4), tmp_path_factory.mktemp("split")
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    sources, truth = {1: [], 2: [], 3: []}, []
    for i in range(240):
        name, street, number = f"{word()} {word()}", f"{word()} Street", rng.randrange(1, 900)
        sources[1].append((f"S1-{i}", name, f"{number} {street}", "IN"))
        found = [] if i % 3 == 0 else [2] if i % 3 == 1 else [2, 3]
        for s in found:
            sources[s].append((f"S{s}-{i}", name.upper() + rng.choice([" Ltd", "", " Inc"]), f"{number} {street.replace('Street', 'St')}", "in"))
        sources[2].append((f"S2-{i + 1000}", f"{name.split()[0]} {word()}", f"{rng.randrange(1, 900)} {street}", "IN"))
        truth.append((f"S1-{i}", ",".join(f"S{s}-{i}" for s in found)))
    for prefix in ("train", "test"):
        for s, rows in sources.items():
            (folder / f"{prefix}_source{s}.tsv").write_text("\t".join(FIELDS) + "\n" + "".join("\t".join(r) + "\n" for r in rows))
    (folder / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(r) + "\n" for r in truth))
    return folder
