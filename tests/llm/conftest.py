import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, key string, size string, ids string, "
          "score string, rep string, part string, text_hash string, removed_chunks string")

LONG = " ".join(f"word{i % 977} and then some{i}" for i in range(6000))


def edge_rows():
    """Nulls in any column, empty, white, symbol-only, special, very long and repeated texts."""
    texts = {
        1: "The quick brown fox\njumps over it.\n\nDon't stop; we'll go 'round   again\t end ",
        2: None, 3: "", 4: " \t\n ", 5: "日本語 über ÉCOLE naïve \U0001f600 ½ x²",
        6: "<|endoftext|> a <|endoftext|>b</s><s> <0x41> ▁▁x", 7: LONG, 8: LONG, 9: LONG + " tail",
        10: "one", 11: "one", 12: "a" * 3000, 13: "!!! ??? ###", 14: "x\ry\x0bz\x1cq\x85w",
    }
    rows = [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t)) for i, t in texts.items()]
    rows += [(None, "no id at all", "en", None, 12), (1, texts[1], "en", "s", None), (1, texts[1], "en", "s", None)]
    return [(*r, 7, *["clash"] * 8) for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
