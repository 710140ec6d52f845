"""Ingestion, the operational sync, and a whole refresh."""

import glob
import json
import os
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feederlake.checks.catalog import BENCH_MODEL, LOCAL_CALLER, MASKED_CALLER, PII_CALLER, access, network, view
from feederlake.checks.landed import landed_twice
from feederlake.functions.curve import hilbert, place_number
from feederlake.operators.snapshot import KeyedTable
from feederlake.plans import risk
from feederlake.plans.build import STORED, refresh
from feederlake.plans.layers import near_box
from feederlake.plans.network import Network, Settings
from feederlake.plans.questions import QUESTIONS, ask, ask_counted
from feederlake.plans.secured import SecuredView
from feederlake.sources.mapped import AS_OF, FEATURE_WINTER, LABEL_WINTER, MappedTables
from feederlake.sources.tables import PLACED, TableStore, bind, literal_rows, row_count
from feederlake.streaming.ingest import Landing
from feederlake.streaming.sync import Mirror


@pytest.fixture()
def root():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _land(root, name, file, text):
    os.makedirs(f"{root}/landed/{name}", exist_ok=True)
    with open(f"{root}/landed/{name}/{file}", "w") as out:
        out.write(text)


HEADER = "transformer_id,pole_id,kva,install_year,phase,manufacturer"


def test_each_file_is_ingested_once_and_later_files_win(spark, root):
    landing = Landing(spark, f"{root}/landed", f"{root}/bronze")
    _land(root, "transformers", "a.csv", f"{HEADER}\nT1,P1,25,1980,A,X\nT2,P2,50,1990,B,Y\n")
    assert landing.ingest("transformers") == 2
    assert landing.ingest("transformers") == 0
    _land(root, "transformers", "b.csv", f"{HEADER}\nT1,P1,100,1980,A,X\n")
    assert landing.ingest("transformers") == 1
    rows = landing.bronze("transformers").collect()
    assert len(rows) == 3 and all(r._source_file.endswith(".csv") for r in rows)
    net = Network(spark, landing.bronze, Settings(AS_OF, FEATURE_WINTER, LABEL_WINTER))
    assert {r.transformer_id: r.kva for r in net.latest("transformers").collect()} == {"T1": 100.0, "T2": 50.0}
    again = Landing(spark, f"{root}/landed", f"{root}/bronze", generation=2)  # full refresh
    assert again.ingest("transformers") == 3


def test_new_columns_are_added(spark, root):
    landing = Landing(spark, f"{root}/landed", f"{root}/bronze")
    _land(root, "transformers", "a.csv", f"{HEADER}\nT1,P1,25,1980,A,X\n")
    landing.ingest("transformers")
    _land(root, "transformers", "b.csv", f"{HEADER},cooling,weight\nT2,P2,50,1990,B,Y,oil,120\n")
    landing.ingest("transformers")
    rows = {r.transformer_id: r for r in landing.bronze("transformers").collect()}
    assert rows["T1"].cooling is None and rows["T2"].cooling == "oil" and rows["T2"].weight == 120

    line = {"line_id": "L1", "substation_code": "S", "ced_code": "C", "voltage_kv": 25, "commissioning_year": 1990,
            "conductor": "ACSR"}
    _land(root, "lines", "a.json", json.dumps(line) + "\n")
    landing.ingest("lines")
    _land(root, "lines", "b.json", json.dumps({**line, "line_id": "L2", "owner": "us"}) + "\n")
    landing.ingest("lines")
    assert {r.line_id: r.owner for r in landing.bronze("lines").collect()} == {"L1": None, "L2": "us"}


def test_csv_columns_are_bound_by_name(spark, root):
    """Reordered, quoted and differently grown headers in one run; a value may hold a comma."""
    landing = Landing(spark, f"{root}/landed", f"{root}/bronze")
    _land(root, "transformers", "a.csv", f"{HEADER}\nT1,P1,25,1980,A,X\n")
    _land(root, "transformers", "b.csv", 'pole_id,transformer_id,"kva",install_year,phase,manufacturer\nP2,T2,50,1990,B,"Y, Inc"\n')
    _land(root, "transformers", "c one.csv", f'"transformer_id","pole_id",kva,install_year,phase,manufacturer,cooling\nT3,P3,5,1,A,X,oil\n')
    _land(root, "transformers", "d.csv", f"{HEADER},weight\nT4,P4,5,1,A,X,120\n")
    assert landing.ingest("transformers") == 4
    rows = {r.transformer_id: r for r in landing.bronze("transformers").collect()}
    assert [rows[f"T{i}"].pole_id for i in (1, 2, 3, 4)] == ["P1", "P2", "P3", "P4"]
    assert rows["T2"].manufacturer == "Y, Inc" and rows["T2"].kva == 50
    assert [rows[t].cooling for t in ("T1", "T3", "T4")] == [None, "oil", None]
    assert rows["T4"].weight == 120 and rows["T3"].weight is None
    _land(root, "transformers", "e.csv", "kva,transformer_id\n7,T5\n")
    assert landing.ingest("transformers") == 1
    rows = {r.transformer_id: r for r in landing.bronze("transformers").collect()}
    assert rows["T5"].kva == 7 and rows["T5"].pole_id is None and rows["T3"].cooling == "oil"
    _land(root, "transformers", "f.csv", "kva,kva\n7,8\n")
    with pytest.raises(Exception, match="must be there and differ"):
        landing.ingest("transformers")


def test_values_that_do_not_fit_are_kept_beside_the_row(spark, root):
    landing = Landing(spark, f"{root}/landed", f"{root}/bronze")
    _land(root, "transformers", "a.csv", f"{HEADER}\nT1,P1,abc,1980,A,X\nT2,P2,50,1990,B,Y\nT3,P3,5\n")
    assert landing.ingest("transformers") == 3
    rows = {r.transformer_id: r for r in landing.bronze("transformers").collect()}
    assert rows["T1"].kva is None and rows["T1"].pole_id == "P1" and rows["T1"].install_year == 1980 and rows["T2"].kva == 50
    assert {r.transformer_id: r._rescued for r in landing.rescued("transformers").collect()} == {
        "T1": "T1,P1,abc,1980,A,X", "T3": "T3,P3,5"}
    line = {"line_id": "L1", "substation_code": "S", "voltage_kv": "high", "commissioning_year": 1990}
    _land(root, "lines", "a.json", json.dumps(line) + "\n" + json.dumps({**line, "line_id": "L2", "voltage_kv": 25}) + "\n")
    landing.ingest("lines")
    rows = {r.line_id: r for r in landing.bronze("lines").collect()}
    assert (rows["L1"].voltage_kv, rows["L1"].commissioning_year, rows["L2"].voltage_kv) == (None, 1990, 25)
    (kept,) = landing.rescued("lines").collect()
    assert json.loads(kept._rescued) == line and "_rescued" not in landing.bronze("lines").columns


def test_undeclared_columns_grow_wider_declared_ones_do_not(spark, root):
    landing = Landing(spark, f"{root}/landed", f"{root}/bronze")
    for file, row in (("a", "T1,P1,25,1980,A,X,120"), ("b", "T2,P2,25,1980.5,A,X,0.5"), ("c", "T3,P3,25,1980,A,X,7"),
                      ("d", "T4,P4,25,1980,A,X,heavy")):
        _land(root, "transformers", f"{file}.csv", f"{HEADER},weight\n{row}\n")
        assert landing.ingest("transformers") == 1
    table = landing.bronze("transformers")
    assert dict(table.dtypes)["weight"] == "double" and dict(table.dtypes)["install_year"] == "int"
    rows = {r.transformer_id: r for r in table.collect()}
    assert [rows[f"T{i}"].weight for i in (1, 2, 3, 4)] == [120.0, 0.5, 7.0, None]
    assert rows["T2"].install_year is None
    assert sorted(r.transformer_id for r in landing.rescued("transformers").collect()) == ["T2", "T4"]


def test_nothing_landed_and_parquet(spark, root):
    landing = Landing(spark, f"{root}/landed", f"{root}/bronze")
    assert landing.ingest("poles") == 0
    load = "transformer_id string, reading_date date, peak_kva double, energy_kwh double"
    rows = spark.createDataFrame([("T1", None, 1.0, 2.0)], load)
    rows.write.mode("append").parquet(landing.folder("transformer_load"))
    assert landing.ingest("transformer_load") == 1
    rows.withColumn("quality", F.lit("ok")).select("quality", *rows.columns).write.mode("append").parquet(
        landing.folder("transformer_load"))
    assert landing.ingest("transformer_load") == 1
    assert sorted(r.quality or "" for r in landing.bronze("transformer_load").collect()) == ["", "ok"]


def test_an_invalid_territory_stops_the_refresh(spark, root):
    landing = Landing(spark, f"{root}/landed", f"{root}/bronze")
    centre = {"ced_code": "C", "ced_name": "n", "region_name": "r", "is_urban": True,
              "boundary_wkt": "POLYGON((-74 46, -73 46, -73 47))"}
    _land(root, "ced", "a.json", json.dumps(centre) + "\n")
    landing.ingest("ced")
    net = Network(spark, landing.bronze, Settings(AS_OF, FEATURE_WINTER, LABEL_WINTER))
    with pytest.raises(Exception, match="valid_polygon"):
        net.table("silver.operating_centers").collect()


def _state(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, v int, updated_at int")


def test_mirror_follows_repeats_and_rebuilds(spark, root):
    source = KeyedTable(TableStore(spark, f"{root}/source"), "ops", "id", ["updated_at"])
    mirror = Mirror(source, TableStore(spark, f"{root}/mirror"))
    assert source.merge(_state(spark, ("a", 1, 1), ("b", 2, 1), ("c", 3, 1))) == {"I": 3}
    assert mirror.sync() == "incremental"
    assert source.merge(_state(spark, ("a", 1, 2), ("b", 2, 2), ("c", 3, 2))) == {"S": 3}
    assert source.store.version("ops") == 1  # time stamps alone write nothing
    counts = source.merge(_state(spark, ("a", 1, 3), ("b", 20, 3), ("d", 4, 3)))
    assert counts == {"S": 1, "U": 1, "D": 1, "I": 1}
    assert mirror.sync() == "incremental"
    assert {r.id: r.v for r in mirror.rows().collect()} == {"a": 1, "b": 20, "d": 4}
    # an old version landed again changes nothing
    old = spark.read.parquet(f"{source.feed_path}/change_version=1")
    old.write.mode("append").parquet(f"{source.feed_path}/change_version=1")
    assert mirror.sync() == "incremental"
    assert {r.id: r.v for r in mirror.rows().collect()} == {"a": 1, "b": 20, "d": 4}
    # a damaged copy is rebuilt from the snapshot
    mirror.store.replace("ops", mirror.store.read("ops").withColumn("v", F.lit(0)))
    assert mirror.sync() == "rebuilt"
    assert {r.id: r.v for r in mirror.rows().collect()} == {"a": 1, "b": 20, "d": 4}


def test_store_versions_and_insert_only_merge(spark, root):
    store = TableStore(spark, root)
    rows = literal_rows(spark, "p string, c string", [("a", "A")])
    store.append_missing("access", rows, ["p", "c"])
    store.append_missing("access", literal_rows(spark, "p string, c string", [("a", "A"), ("b", "B")]), ["p", "c"])
    assert row_count(store.read("access")) == 2 and row_count(store.read("access", 1)) == 1
    store.create_view("access", "access_view")
    assert bind(spark, "SELECT c FROM access_view WHERE p = :p", p="b").first().c == "B"
    store.prune("access", keep=1)
    assert store.versions("access") == [2]


def test_refresh_stores_every_product_and_is_repeatable(spark, folder, root):
    tables = MappedTables(spark, folder)
    settings = Settings(AS_OF, FEATURE_WINTER, LABEL_WINTER)
    extract = landed_twice(tables)
    net = Network(spark, extract, settings, store=TableStore(spark, root), scorer=risk.last_winter_scorer)
    net.count_violations = True
    written = refresh(net)
    assert set(STORED) <= set(written)
    assert net.observations["outages"].get["valid_customers"] > 0
    assert "/" in net.store.read("gold.outages").schema["chi"].metadata["comment"]
    stored = Network(spark, extract, settings, store=net.store)
    fresh = Network(spark, extract, settings, scorer=risk.last_winter_scorer)
    view, plain = (SecuredView(n, MASKED_CALLER, access(n)) for n in (stored, fresh))
    for question, parameters in (("oldest_poles", {"line": "Supplier#000000003"}), ("highest_chi_zones", {})):
        assert question in QUESTIONS
        assert ask(view, question, **parameters).collect() == ask(plain, question, **parameters).collect()
    first, total = ask_counted(view, "oldest_poles", 3, line="Supplier#000000003")
    assert first.collect() == ask(view, "oldest_poles", line="Supplier#000000003").collect()[:3] and total == 20
    ops = KeyedTable(net.store, "gold.ops_line_status", "line_id", ["updated_at"])
    before = net.store.version("gold.ops_line_status")
    from feederlake.plans.network import PRODUCTS
    assert set(ops.merge(PRODUCTS["gold.ops_line_status"](stored))) == {"S"}
    assert net.store.version("gold.ops_line_status") == before


def test_merge_refuses_keys_that_would_multiply(spark, root):
    table = KeyedTable(TableStore(spark, root), "t", "k")
    good = literal_rows(spark, "k string, v int", [("a", 1), ("b", 2)])
    for bad in ([("a", 1), ("a", 1)], [("a", 1), (None, 2)]):
        with pytest.raises(ValueError, match="stands on"):
            table.merge(literal_rows(spark, "k string, v int", bad))
    assert table.merge(good) == {"I": 2}
    assert [table.merge(good) for _ in range(3)] == [{"S": 2}] * 3
    assert row_count(table.snapshot()) == 2


def test_secured_view_refuses_exact_personal_data(spark, folder):
    masked, reader = view(spark, folder, MASKED_CALLER), view(spark, folder, PII_CALLER)
    for name in ("silver.customers", "silver.poles", "gold.customers_pii", "bronze.customers"):
        with pytest.raises(PermissionError):
            masked.table(name)
    with pytest.raises(PermissionError):
        reader.table("silver.customers")
    shown = masked.table("gold.customers").first()
    assert shown.customer_name == shown.address == "*** masqué / masked ***"
    assert reader.table("gold.customers_pii").first().customer_name != shown.customer_name


def test_the_row_filter_reaches_the_scan(spark, folder, root):
    net = network(spark, folder)
    store = TableStore(spark, root)
    store.replace("gold.outages", net.table("gold.outages"))
    net.store = store
    net.forget("gold.outages")
    plan = SecuredView(net, LOCAL_CALLER, access(network(spark, folder))).table("gold.outages")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ced_code), EqualTo(ced_code," in text or "In(ced_code" in text


def test_the_curve_visits_every_cell_and_only_steps_to_neighbours(spark):
    cells = spark.range(32 * 32).selectExpr("id % 32 AS x", "id div 32 AS y").selectExpr("x", "y", f"{hilbert('x', 'y', 5)} AS n")
    order = [(r.x, r.y) for r in cells.orderBy("n").collect()]
    assert {r.n for r in cells.collect()} == set(range(1024))
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(order, order[1:]))
    odd = spark.sql(f"""SELECT {place_number('lon', 'lat')} AS n FROM VALUES (NULL, 1D), (1D, double('NaN')), (double('inf'), 1D),
        (-180D, -90D), (180D, 90D), (400D, -400D) AS t(lon, lat)""")
    assert [r.n is None for r in odd.collect()] == [True] * 3 + [False] * 3


def test_a_drawn_polygon_reads_few_row_groups(spark, root):
    """Stored by place, a selection of a fiftieth of the area needs under a tenth of the row groups of each table."""
    store = TableStore(spark, root, {"parquet.block.size": "4096", "parquet.page.size": "1024"})
    east = "-74D + (id * 7919 % 100003) / 100003D * 4"
    north = "45D + (id * 104729 % 99991) / 99991D * 3"
    places = spark.range(60_000).selectExpr(f"{east} AS lon", f"{north} AS lat", "concat('L', id % 300) AS line_id", "id")
    tables = {
        "gold.poles": places.selectExpr("concat('P', id) AS pole_id", "line_id", "lon", "lat"),
        "gold.transformers": places.selectExpr("concat('T', id) AS transformer_id", "line_id", "lon", "lat"),
        "gold.customers_pii": places.selectExpr("concat('C', id) AS customer_id", "line_id", "lon", "lat"),
        "gold.spans": places.selectExpr("concat('S', id) AS span_id", "line_id", "lon AS lon1", "lat AS lat1",
                                        "lon + 0.001 AS lon2", "lat - 0.001 AS lat2")}
    for name, df in tables.items():
        store.replace(name, df)
        stored = store.read(name)
        assert stored.columns == df.columns and stored.count() == 60_000
        lon, lat, _ = PLACED[name]
        groups = []
        for file in glob.glob(f"{root}/{name}/v*/*.parquet"):
            footer = pq.ParquetFile(file).metadata
            for g in range(footer.num_row_groups):
                columns = {footer.row_group(g).column(c).path_in_schema: footer.row_group(g).column(c).statistics
                           for c in range(footer.num_columns)}
                groups.append((columns[lon], columns[lat]))
        met = [1 for x, y in groups if x.max >= -72.5 and x.min <= -71.9 and y.max >= 46.0 and y.min <= 46.4]
        assert len(groups) >= 100 and len(met) < len(groups) / 10
    spans = store.read("gold.spans").filter(near_box(-72.5, 46.0, -71.9, 46.4))
    assert "Or(LessThanOrEqual(lon1" in spans._jdf.queryExecution().executedPlan().toString()
    assert spans.count() == store.read("gold.spans").filter(
        "least(lon1, lon2) <= -71.9 AND greatest(lon1, lon2) >= -72.5 AND least(lat1, lat2) <= 46.4 AND greatest(lat1, lat2) >= 46.0").count()

def test_no_answer_is_cut(spark, folder):
    """More than a thousand answers, and a line of 6,000 spans kept in blocks of its branch."""
    net = network(spark, folder)
    spans = spark.range(6000).selectExpr(
        "concat('S', id) AS span_id", "'L' AS line_id", "'L-T' AS branch_id", "CAST(id + 1 AS INT) AS branch_seq",
        "-70D + id * 0.0001 AS lon1", "46D AS lat1", "-70D + (id + 1) * 0.0001 AS lon2", "46D AS lat2",
        "id * 10D AS x1", "0D AS y1", "(id + 1) * 10D AS x2", "0D AS y2", "10D AS length_m")
    net._frames["silver.spans"] = spans
    shapes = net.table("gold.line_shapes").selectExpr("part", "size(paths) AS n").collect()
    assert {(r.part, r.n) for r in shapes} == {(f"L-T#{k}", 1000) for k in range(6)}
    net = network(spark, folder)
    big = net.table("gold.transformers").limit(1).crossJoin(spark.range(1500)).withColumn("install_year", F.lit(1950))
    other = network(spark, folder)
    other._frames["gold.transformers"] = big.withColumn("transformer_id", F.col("id").cast("string"))
    region = big.first().region_name
    assert ask(SecuredView(other, MASKED_CALLER, access(other)), "old_transformers_in_region", region=region).count() == 1500


def test_hold_out_is_stratified(spark):
    rows = spark.range(4000).selectExpr("concat('T', id) AS transformer_id", "CAST(id % 400 = 0 AS INT) AS overload_next_winter")
    train, test = risk.hold_out(rows)
    share = {r[0]: r[1] for r in test.groupBy("overload_next_winter").count().collect()}
    assert 3 <= share[1] <= 4 and 970 <= share[0] <= 1040 and row_count(train) + row_count(test) == 4000


def test_model_beats_chance_on_a_planted_signal(spark):
    rows = spark.range(800).selectExpr(
        "concat('T', id) AS transformer_id", "CAST((id * 37) % 200 AS DOUBLE) AS max_overload_pct",
        "1D AS p95_overload_pct", "1L AS days_over_120", "1L AS days_over_150",
        "CASE WHEN id % 10 = 0 THEN NULL ELSE 1D END AS kva_per_degree_below_15", "50D AS kva", "10 AS age_years",
        "1L AS n_customers", "0.5D AS electric_heating_share", "1D AS customers_per_10kva", "1 AS is_urban",
        "CAST((id * 37) % 200 > 120 AS INT) AS overload_next_winter")
    train, test = risk.hold_out(rows)
    quality = risk.quality(risk.with_score(test, risk.fit(train, BENCH_MODEL))).first()
    assert quality.roc_auc > 0.95 and quality.pr_auc > 0.9
    assert quality.model_recall_at_0_5 >= quality.baseline_last_winter_recall


def test_models_are_versioned_with_a_champion(spark, root):
    rows = spark.range(60).selectExpr(
        "concat('T', id) AS transformer_id", *[f"CAST(id AS DOUBLE) AS {c}" for c in risk.FEATURES],
        "CAST(id > 30 AS INT) AS overload_next_winter")
    store = TableStore(spark, root)
    spec = risk.ModelSpec(rounds=1)
    assert [risk.publish(store, risk.fit(rows, spec)) for _ in range(2)] == [1, 2]
    version, model = risk.champion(store)
    assert version == 2 and risk.champion(store, 1)[0] == 1
    scores = {r.transformer_id: r.risk_score for r in risk.with_score(rows, model).collect()}
    assert scores["T50"] > 0.5 > scores["T5"]


def test_tiers_are_right_closed(spark):
    scores = spark.sql("SELECT explode(array(0.3D, 0.31D, 0.6D, 0.61D)) AS s")
    assert [r[0] for r in scores.select(risk.overload_tier(F.col("s"))).collect()] == ["FAIBLE", "MOYEN", "MOYEN", "ÉLEVÉ"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_zone_status_reads_the_ranked_zones_that_were_written(spark, folder):
    from feederlake.checks.catalog import CHECKS
    status = CHECKS["ops_zone_risk"].run(spark, folder)
    assert status.count() > 0 and "MapInPandas" not in _plan(status)  # no hull is walked for the status or the replies


def test_readings_of_both_winters_are_looked_up_once(spark, folder):
    net = network(spark, folder)
    rows = risk.training_set(net)
    assert rows.count() > 0 and "lineitem" not in _plan(rows) and "lineitem" not in _plan(risk.winter_features(net, LABEL_WINTER))
    early = risk.winter_features(net, FEATURE_WINTER - 1)  # any other winter is looked up by itself
    assert "lineitem" in _plan(early) and early.columns == rows.columns[:len(early.columns)]


@pytest.mark.parametrize("name", ["gold.poles", "silver.poles"])
def test_a_table_in_order_is_computed_once(spark, root, name):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.range(3000).selectExpr("concat('P', id) AS pole_id", "concat('L', id % 7) AS line_id",
                                        "-72 + id % 100 / 100D AS lon", "46 + id % 90 / 100D AS lat")
    store = TableStore(spark, root)
    store.replace(name, rows.mapInPandas(count, rows.schema))
    assert seen.value == 3000
    assert sorted(store.read(name).collect()) == sorted(rows.collect())
    assert os.listdir(f"{root}/{name}") == ["v00000001"]
