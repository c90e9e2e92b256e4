"""The time-belt fallback over all that the earlier steps leave."""

import datetime as dt
import random

from spotcheck.operators import certificates as c
from spotcheck.plans import catalog, certificates
from spotcheck.sources.projection import certs, mappings, spots


def test_fallback_takes_every_brand(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2025, 1, 1)
    rows = [(i, rng.choice([0, 4, 8, 13, 28]), "ch", start + dt.timedelta(seconds=rng.randrange(3 * 86400))) for i in range(250)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    at = str(tmp_path)
    have = {r["cert_id"]: r["air_secs"] for r in certificates.confirmed(spark, at).collect()}
    placed = certificates.placed(spark, at).collect()
    gone = {r["spot_id"] for r in placed}
    open_spots = spots(spark, at)
    open_spots = open_spots.filter(~open_spots["spot_id"].isin(sorted(gone)))
    k = certs(spark, at)
    gone |= {r["spot_id"] for r in c.unconfirmed_to_schedule(k.filter(~k["cert_id"].isin(sorted(have))), open_spots, mappings(spark, at)).collect()}
    left = [r for r in spots(spark, at).collect() if r["spot_id"] not in gone and r["ad_type"] == "COMMERCIAL BENEFITS"]
    waiting = sorted((r for r in k.collect() if r["cert_id"] in have and r["cert_id"] not in {x["cert_id"] for x in placed}), key=lambda r: (r["cert_date"], r["cert_id"]))
    want, used = set(), set()
    for r in waiting:
        best = []
        for p in left:
            if p["spot_id"] in used or (p["account_id"], p["channel"], p["duration"]) != (r["account_id"], r["channel"], r["duration"]) or r["cert_date"] < p["spot_date"]:
                continue
            stop = p["end_secs"] + 86400 * (p["end_secs"] < p["start_secs"] and p["start_secs"] > 43200)
            secs = have[r["cert_id"]]
            secs += 86400 * (stop > 86400 and secs < p["start_secs"])
            far = abs(secs - (p["start_secs"] + stop) / 2)
            if p["start_secs"] <= secs <= stop + 600:
                best.append((1, 0.0, p["spot_date"], p["spot_id"]))
            elif far <= 7200:
                best.append((2, far, p["spot_date"], p["spot_id"]))
        if best:
            used.add(min(best)[3])
            want.add((r["cert_id"], min(best)[3]))
    got = {tuple(r) for r in catalog.QUERIES["cert_time_belt_fallback"](spark, at).collect()}
    assert got == want
    brand = {p["spot_id"]: p["brand"] for p in left}
    theme = {r["cert_id"]: r["tc_theme"] for r in waiting}
    assert any(brand[s] not in ("Brand 13", "Brand 14") or theme[x] not in ("tc theme 13", "tc theme 14") for x, s in got)
