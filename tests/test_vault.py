"""The vault that lasts: tokens stay from run to run, runs read their own buckets, and two writers don't cross."""

import pytest

from veilspark.operators import protect
from veilspark.operators.vault import Vault, VaultChangedError

KEY = b"k" * 32


def named(spark, names, entity="PERSON"):
    return spark.createDataFrame([(entity, n) for n in names], "entity_type string, value string")


def told(df):
    return {(x.entity_type, x.normalised): x.token for x in df.collect()}


def test_tokens_last(spark, tmp_path):
    vault = Vault(spark, f"file://{tmp_path}/vault")
    assert vault.read().count() == 0 and vault.log() == []
    first = told(vault.tokens(named(spark, [f"Budi {k}" for k in range(300)]), KEY))
    assert first == told(protect.assign_tokens(named(spark, [f"Budi {k}" for k in range(300)]), KEY))
    again = vault.tokens(named(spark, [f"BUDI {k}" for k in range(250, 350)]), KEY).collect()
    assert all(x.token == first.get((x.entity_type, x.normalised), x.token) and not x.is_new for x in again) and len(again) == 100
    rows = vault.read().collect()
    assert len(rows) == 350 and len({x.token for x in rows}) == 350 and len(vault.log()) == 2
    assert told(vault.tokens(named(spark, ["Budi 1", "budi 1"]), KEY)) == {("PERSON", "budi 1"): first["PERSON", "budi 1"]} and len(vault.log()) == 2
    assert vault.tokens(named(spark, []), KEY).count() == 0


def test_only_touched_buckets_are_read(spark, tmp_path):
    vault = Vault(spark, f"file://{tmp_path}/vault")
    vault.tokens(named(spark, [f"Siti {k}" for k in range(2_000)]), KEY)
    one = vault.read().first()
    some = vault.read([one.hmac[:2]])
    assert all(f"/bucket={one.hmac[:2]}/" in f for f in some.inputFiles()) and {x.hmac[:2] for x in some.collect()} == {one.hmac[:2]}
    assert vault.read(["zz"]).count() == 0


def test_two_writers(spark, tmp_path):
    a, b = (Vault(spark, f"file://{tmp_path}/vault") for _ in range(2))
    a.tokens(named(spark, ["Agus"]), KEY)
    version, log = len(b.log()), b.log()
    mine = named(spark, [f"Dewi {k}" for k in range(400)])
    touched = sorted({x.hmac[:2] for x in protect.assign_tokens(mine, KEY).collect()})
    made = protect.assign_tokens(mine, KEY, b.read(touched, log))
    a.tokens(named(spark, [f"Dewi {k}" for k in range(200)]), KEY)  # meanwhile
    with pytest.raises(VaultChangedError):
        b._add(made, touched, version)
    assert len(a.log()) == 2
    assert told(b.tokens(mine, KEY)) | told(a.read().limit(0).selectExpr("entity_type", "hmac normalised", "token")) == told(a.tokens(mine, KEY))
    rows = a.read().collect()
    assert len({x.token for x in rows}) == len({(x.entity_type, x.hmac) for x in rows}) == len(rows) == 401
    # other buckets are none of a writer's business
    one = protect.assign_tokens(named(spark, ["Rina"]), KEY)
    bucket = one.first().hmac[:2]
    state = a.log()
    other = next(n for n in (f"Joko {k}" for k in range(99)) if protect.assign_tokens(named(spark, [n]), KEY).first().hmac[:2] != bucket)
    a.tokens(named(spark, [other]), KEY)
    b._add(one, [bucket], len(state))
    assert len(b.log()) == len(state) + 2
