"""Published bundles: whole versions only, the pointer, going back, scoring without a fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carescope.operators import boosting, features, models, score
from carescope.plans import queries as Q
from carescope.sources import bundles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    enc, spec = Q.encoded_cohort(spark, SF)
    model, _ = boosting.fit_boosted(enc.where("split = 'train'"), spec.feature_names(), params=boosting.BoostParams(rounds=4, min_child_samples=5))
    platt = models.fit_platt(model.score(enc.where("split <> 'train'")))
    return enc, spec, model, platt


def test_publish_load_and_score(spark, made, tmp_path, monkeypatch):
    enc, spec, model, platt = made
    root = str(tmp_path / "models")
    version = bundles.publish(spark, root, spec, model, platt, {"rounds": 4})
    for fit in ((features, "fit_vocabulary"), (boosting, "fit_boosted"), (models, "fit_platt")):
        monkeypatch.setattr(*fit, lambda *a, **k: pytest.fail("scoring fits nothing"))
    b = bundles.load(spark, root)
    assert (b.version, b.platt, b.card) == (version, platt, {"rounds": 4})
    src = Q.cleaned(spark, SF).drop("readmitted", "prior_n", "o_orderdate", "score", "patient_nbr")
    got = {r.row_key: r.probability for r in score.score_batch(src, b.spec, b.scorer()).collect() if r.valid}
    want = model.score(enc).withColumn("p", models.calibrated(F.col("probability_1"), *platt)).select("encounter_id", "p").collect()
    both = [r for r in want if r.encounter_id in got]
    assert both and np.allclose([got[r.encounter_id] for r in both], [r.p for r in both], atol=1e-9)


def test_half_written_versions_are_never_read(spark, made, tmp_path, monkeypatch):
    _, spec, model, platt = made
    root = str(tmp_path / "models")
    with pytest.raises(bundles.NotPublished):
        bundles.load(spark, root)
    first = bundles.publish(spark, root, spec, model, platt)
    monkeypatch.setattr(boosting.BoostedTrees, "save", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        bundles.publish(spark, root, spec, model, platt)
    monkeypatch.undo()
    assert len(list((tmp_path / "models/versions").iterdir())) == 2 and bundles.load(spark, root).version == first
    half = next(p.name for p in (tmp_path / "models/versions").iterdir() if p.name != first)
    with pytest.raises(bundles.NotPublished):
        bundles.make_current(spark, root, half)


def test_pointer_moves_on_and_back(spark, made, tmp_path):
    _, spec, model, platt = made
    root = str(tmp_path / "models")
    one, two = bundles.publish(spark, root, spec, model.first(1)), bundles.publish(spark, root, spec, model, platt)
    assert bundles.load(spark, root).version == two and len(bundles.load(spark, root, one).model.trees) == 1
    bundles.make_current(spark, root, one)
    assert bundles.load(spark, root).version == one and bundles.load(spark, root).platt is None
    assert [n for n, _ in bundles.versions(spark, root)] == [1, 2, 3]
    with pytest.raises(bundles.NotPublished):
        bundles.load(spark, root, "other")


def test_changed_files_are_refused(spark, made, tmp_path):
    _, spec, model, platt = made
    root = str(tmp_path / "models")
    version = bundles.publish(spark, root, spec, model, platt)
    part = next((tmp_path / f"models/versions/{version}/card").glob("part-*"))
    part.write_text(part.read_text() + " ")
    with pytest.raises(ValueError, match="not as it was published"):
        bundles.load(spark, root)
    with pytest.raises(ValueError, match="order"):
        bundles.publish(spark, root, spec, boosting.replace(model, features=model.features[::-1]))
