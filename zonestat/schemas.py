"""Schemas of inputs and outputs; nothing on a hot path is inferred."""

SLAB = "time timestamp, latitude float, longitude float, value float"
MASK = "latitude double, longitude double, weight double"
DAILY = "date date, n long, mean double, mean_wt double, sd double, min double, max double, p10 double, p90 double, weight_sum double"
CATEGORICAL = "date date, class long, n long, weight double, fraction double, percent_cells double"
IDENTITY = "place_id string, dataset_id string, variable string"
PLACE_INDEX = (
    "place_id string, name string, authority string, place_type string, geom_type string, collection string, "
    "bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, centroid_lon double, centroid_lat double, area_km2 double, group_id string"
)
INFO = "`row type` string, variable string, attribute string, `data type` string, value string"
