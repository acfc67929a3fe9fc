import random

import pytest
from pyspark.sql import functions as F

WORDS = ("the of and to in is was for on with house river stone cloud paper green seven walk talk bright "
         "mountain simple garden window letter number table summer winter").split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, blanks, ties, repeats, copies, near copies, one long text, and extra
    columns whose names the operators use themselves."""
    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t + "  ") for i, t in enumerate(base[:4])]                   # equal but for blanks
    rows += [(200 + i, t.upper() + " end") for i, t in enumerate(base[4:8])]        # near copies
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "word"), (304, "two words"), (305, "Word")]
    rows += [(306, "é ü ñ \U0001F600 " + base[0]), (307, "12 34 !!"), (308, "日本語 の 文章")]
    rows += [(5, base[5]), (None, base[2]), (None, None), (None, "no id here at all today")]
    rows += [(400, " ".join(rng.choice(WORDS) for _ in range(30000)))]
    rows += [(500 + i, base[1] + " " + str(i)) for i in range(40)]                  # a group of near copies
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "digest": F.lit(1),
                           "n_chars": F.length("text").cast("bigint"), "score": F.lit("x"), "component": F.lit(2.5),
                           "a": F.array(F.lit(1)), "part": F.lit(0), "label": F.lit(0), "learn": F.lit(True)})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
