import http.server
import json
import threading

from pyspark.sql import functions as F

from brinelog.sources import files, schemas


def test_json_lines_with_malformed_ones(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"logged_at": "2026-02-01 10:00:00", "cetp_cod": 210.0}\n{"logged_at": "2026-02\n{"logged_at": "2026-02-02 10:00:00"}\n')
    rows = files.jsonl(spark, str(tmp_path / "log"), schemas.EVIDENCE, newest_first="logged_at").collect()
    assert [(r["logged_at"], r["cetp_cod"]) for r in rows] == [("2026-02-02 10:00:00", None), ("2026-02-01 10:00:00", 210.0)]
    assert files.tamper_log(spark, str(tmp_path / "none")).count() == 0


def test_timeline_and_sensor(spark, tmp_path):
    df = spark.createDataFrame([("t1", "12.5"), ("t2", " NA "), ("t3", ""), ("t4", "nan"), ("t5", None), ("t6", "NaN?")], "time string, cetp_inlet_cod string")
    assert {r["time"]: r["is_valid"] for r in files.timeline(df).collect()} == {"t1": True, "t2": False, "t3": False, "t4": False, "t5": False, "t6": True}
    (tmp_path / "cetp_clean.csv").write_text(",".join(f.name for f in schemas.CETP) + "\n1,2026-02-28 12:00,210.5,1,7,1,1,1,7,1\n")
    (tmp_path / "cetp_old.csv").write_text(",".join(f.name for f in schemas.CETP) + "\n2,2026-02-28 12:00,99,1,7,1,1,1,7,1\n")
    row = files.plant_readings(spark, str(tmp_path)).collect()
    assert [(r["sensor_id"], r["cetp_inlet_cod"]) for r in row] == [("CETP_INLET", 210.5)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    df = spark.range(3).select(F.col("id").cast("double").alias("cetp_cod"))
    for batch in (0, 1, 1):
        files.append_jsonl(df, str(tmp_path / "log"), batch)
    assert files.jsonl(spark, str(tmp_path / "log"), schemas.EVIDENCE).count() == 6


def test_webhook():
    got = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *args): ...

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.handle_request, daemon=True).start()
    assert files.post_webhook({"a": 1}, f"http://127.0.0.1:{server.server_port}/") and got == [{"a": 1}]
    server.server_close()
    assert not files.post_webhook({}, "") and not files.post_webhook({}, f"http://127.0.0.1:{server.server_port}/", 0.5)


def test_compressed_csv_is_read_back(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("s_no"), F.lit("2026-02-28 12:00").alias("time"), F.lit("A").alias("factory_id"), F.lit(100.0).alias("cod"), F.lit(1.0).alias("bod"), F.lit(7.0).alias("ph"), F.lit(2.0).alias("tss")).coalesce(1)
    files.write_csv(rows, str(tmp_path / "plain"))
    files.write_csv(rows, str(tmp_path / "packed"), compression="gzip")
    size = {k: sum(p.stat().st_size for p in (tmp_path / k).glob(f"*.csv{end}")) for k, end in (("plain", ""), ("packed", ".gz"))}
    assert 0 < 4 * size["packed"] < size["plain"]
    got = files.factory_readings(spark, str(tmp_path / "packed"), glob="*.csv.gz")
    assert got.drop("status").exceptAll(rows).count() == 0 and got.count() == 5000
