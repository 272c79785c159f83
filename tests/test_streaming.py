import tempfile

from landfold.streaming import arrivals


def test_summaries_follow_arrivals(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(0, s, x, y, 10 * x, 10 * y, 5) for s in "ab" for x in range(4) for y in range(4)]
    px = spark.createDataFrame(rows, "site_id long, scene_id string, x long, y long, r int, g int, b int")

    def arrive(part):
        part.write.mode("append").parquet(f"{top}/in")
        arrivals.keep_summaries(arrivals.arriving_pixels(spark, f"{top}/in", px.schema), f"{top}/out", f"{top}/check").awaitTermination()
        return sorted(map(tuple, arrivals.latest_summaries(spark, f"{top}/out").select("site_id", "scene_id", "pixels", "lum", "chroma", "grayscale").collect()))

    order = ["site_id", "scene_id", "pixels", "lum", "chroma", "grayscale"]
    assert arrive(px.where("scene_id = 'a' and x < 2")) == sorted(map(tuple, arrivals.scene_summaries(px.where("scene_id = 'a' and x < 2")).select(order).collect()))
    assert arrive(px.where("not (scene_id = 'a' and x < 2)")) == sorted(map(tuple, arrivals.scene_summaries(px).select(order).collect()))
