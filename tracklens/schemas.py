"""Schemas of the telemetry tables, as DDL."""

TRACK = "track_id string, t timestamp, lat double, lon double, ele double, speed double"
IMU_FRAME = "frame int, timestamp bigint, qw double, qx double, qy double, qz double, ax_g double, ay_g double, az_g double, iso double, shutter_raw string, color_temp_K int, sensor_temp_C double"
IMU_RATE = "frame int, subidx int, qw double, qx double, qy double, qz double"
LENS = "fx double, fy double, cx double, cy double, dist array<double>, width double, height double, yaw_deg double, pitch_deg double, extrinsic_quat array<double>, radial_lut_1 array<double>, radial_lut_2 array<double>"
CALIBRATION = f"proto string, fw_a string, proto_ver string, serial string, fw_b string, model string, boot_ts bigint, initial_quat array<double>, lenses array<struct<{LENS.replace(' ', ':').replace(',:', ',')}>>"
BOX = "depth int, parent_off bigint, typ string, off bigint, size bigint, hdr int"
MP4_TRACK = "trak int, track_id int, codec string, handler string, timescale bigint, sizes array<bigint>, chunk_offsets array<bigint>, stsc array<struct<first:bigint,spc:bigint,sdi:bigint>>, stts array<struct<cnt:bigint,dur:bigint>>"
PB_FIELD = "field int, ord int, wire_type int, varint decimal(20,0), raw binary"
CAMM = "sample int, epoch double, fix_type int, lat double, lon double, alt float, h_acc float, v_acc float, vel_e float, vel_n float, vel_up float, speed_acc float"
