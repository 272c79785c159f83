"""The column contract: a raster is the rows of one (site_id, scene_id), a pixel one (x, y) in it."""

K = ["site_id", "scene_id"]
PIXEL = [*K, "x", "y"]
