"""Schemas of the engine's tables (Spark DDL)."""

INTRINSICS = "K ARRAY<ARRAY<DOUBLE>>, D ARRAY<ARRAY<DOUBLE>>, img_size ARRAY<INT>, rms DOUBLE, camera_height_m DOUBLE"
GCP = "label STRING, pixel_u DOUBLE, pixel_v DOUBLE, lat DOUBLE, lon DOUBLE, elev_m DOUBLE"
GRID_POINT = "pixel_x INT, pixel_y INT, lat DOUBLE, lon DOUBLE"
IMU = "timestamp STRING, tilt_deg DOUBLE, roll_deg DOUBLE, yaw_deg DOUBLE, temp_c DOUBLE, calib_sys INT, calib_gyro INT, calib_accel INT, calib_mag INT"
IMAGE_META = "path STRING, lat DOUBLE, lon DOUBLE, alt DOUBLE, roll_deg DOUBLE, pitch_deg DOUBLE, yaw_deg DOUBLE"
CAMERA_POSE = "frame_id STRING, lat_deg DOUBLE, lon_deg DOUBLE, alt_ellipsoid_m DOUBLE, sigma_h_m DOUBLE, sigma_v_m DOUBLE, yaw_deg DOUBLE, pitch_deg DOUBLE, roll_deg DOUBLE, sigma_yaw_deg DOUBLE, sigma_pitch_deg DOUBLE, sigma_roll_deg DOUBLE"
OPF_CAPTURES = "captures ARRAY<STRUCT<id: STRING, geolocation: STRUCT<coordinates: ARRAY<DOUBLE>, sigmas: ARRAY<DOUBLE>>, orientation: STRUCT<angles_deg: ARRAY<DOUBLE>, sigmas_deg: ARRAY<DOUBLE>>>>"
SCENE_FRAME = "base_to_canonical STRUCT<shift: ARRAY<DOUBLE>, scale: ARRAY<DOUBLE>, swap_xy: BOOLEAN>, crs STRING"
POINT = "x DOUBLE, y DOUBLE, z DOUBLE, r INT, g INT, b INT"
DEM_TILE = "tile_id INT, priority INT, crs STRING, x0 DOUBLE, y0 DOUBLE, dx DOUBLE, dy DOUBLE, rows INT, cols INT, nodata DOUBLE"
DEM_CELL = "tile_id INT, row INT, col INT, z DOUBLE"
SCENE = "id STRING, properties STRUCT<acquired: STRING, cloud_cover: DOUBLE, satellite_id: STRING, item_type: STRING, gsd: DOUBLE>"
POLE = "row MAP<STRING, STRING>"
