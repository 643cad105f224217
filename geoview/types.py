"""Schemas of the domain's inputs; nothing is inferred from data."""

_XYZ = "struct<x:double,y:double,z:double>"
_IMAGE = (
    "imagefile:string,file:string,image:string,location:array<double>,pos:array<double>,loc:array<double>,"
    "rotation:array<double>,rot:array<double>,quaternion:array<double>,fovy:{f},fov:{f},fieldofview:{f}"
)
#: ``fovy`` may be a number or a list, so it is read as text first.
POSES = f"images array<struct<{_IMAGE.format(f='string')}>>"
CORRECTION = f"struct<`start frame`:int,`end frame`:int,translation:{_XYZ},rotation:{_XYZ}>"
CORRECTIONS = f"corrections map<string,array<{CORRECTION}>>, default struct<translation:{_XYZ},rotation:{_XYZ}>"
FLIGHT_CORRECTIONS = f"corrections array<{CORRECTION}>, default struct<translation:{_XYZ},rotation:{_XYZ}>, translation {_XYZ}, rotation {_XYZ}"
STATE = "struct<coordinates:array<double>,label:string,track:string>"
FLIGHT = f"struct<nr_of_frames_before_current:int,nr_of_frames_after_current:int,labels:map<string,map<string,{STATE}>>>"
EXPORT = f"metadata struct<included_flights:array<string>,neighbor_frame_fps:int,labels:map<string,string>>, missions map<string,struct<flights:map<string,{FLIGHT}>>>"
LEGACY_LABELS = "states array<struct<frameIdx:int,pxlCoordinates:array<struct<x:double,y:double>>>>"
LEGACY_INFO = f"correction struct<translation:{_XYZ},rotation:{_XYZ}>"
YOLO = "class_id int, xc double, yc double, w double, h double"
VERTICES = "vid bigint, x double, y double, z double"
TRIANGLES = "tid bigint, a bigint, b bigint, c bigint"
