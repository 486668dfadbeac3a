"""Rejection by distance: junk and other languages against texts of the model's own."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from threadmill.llm import langid

WORDS = {
    "en": "the and morning market of square was full people who bought fruit vegetables fresh bread while children ran between stalls laughing loudly old talked about weather with each other before going home again through narrow streets that were still wet from last night's rain".split(),
    "es": "la mañana temprano el mercado de plaza estaba lleno gente que compraba fruta verdura y pan fresco mientras los niños corrían entre puestos riendo en voz alta viejos hablaban del tiempo unos con otros antes volver a casa por calles estrechas todavía mojadas".split(),
}
OTHER = {
    "tr": "sabah erkenden meydandaki pazar meyve sebze ve taze ekmek alan insanlarla doluydu çocuklar tezgahların arasında gülerek koşuyor yaşlılar ise havadan konuşuyordu".split(),
    "fi": "aikaisin aamulla torin kauppa oli täynnä ihmisiä jotka ostivat hedelmiä vihanneksia ja tuoretta leipää kun lapset juoksivat kojujen välissä nauraen".split(),
}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS[x]) for _ in range(rng.randint(20, 200))), x) for i in range(800) for x in [rng.choice(list(WORDS))]]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), F.lit(True))


def rejected(spark, model, texts):
    rows = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    return {r["doc_id"] for r in langid.predict(rows, model).collect() if r["rejected"]}


def test_junk_and_other_languages_are_rejected(spark, model):
    rng = random.Random(7)
    junk = {}
    for n in (200, 1500):
        junk[f"letters {n}"] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        junk[f"base64 {n}"] = base64.b64encode(rng.randbytes(n * 3 // 4)).decode()
        junk |= {f"{x} {n}": " ".join(rng.choice(w) for _ in range(n // 6)) for x, w in OTHER.items()}
    assert rejected(spark, model, junk) == set(junk)


def test_own_languages_are_kept_at_all_lengths(spark, model):
    rng = random.Random(8)
    own = {f"{x} {n} {k}": " ".join(rng.choice(w) for _ in range(n)) for x, w in WORDS.items() for n in (1, 3, 10, 40, 300) for k in range(10)}
    assert not rejected(spark, model, own)
