"""Actor classes, priors, radii and the positional feature layouts."""

from __future__ import annotations

ACTOR_CLASSES = ["car", "pedestrian", "two_wheeler", "auto_rickshaw", "bus", "truck", "bicycle", "other"]

SIZE_PRIORS = {"car": 0.60, "pedestrian": 0.10, "two_wheeler": 0.25, "auto_rickshaw": 0.40, "bus": 1.00, "truck": 0.90, "bicycle": 0.20, "other": 0.30}

#: Interaction radius in metres of unordered class pairs.
PAIR_RADII = {
    ("car", "car"): 6.0,
    ("car", "pedestrian"): 4.0,
    ("car", "two_wheeler"): 5.0,
    ("car", "auto_rickshaw"): 5.0,
    ("car", "bus"): 7.0,
    ("car", "truck"): 7.0,
    ("car", "bicycle"): 4.0,
    ("pedestrian", "pedestrian"): 2.0,
    ("pedestrian", "two_wheeler"): 3.5,
    ("pedestrian", "auto_rickshaw"): 4.0,
    ("pedestrian", "bus"): 5.0,
    ("pedestrian", "truck"): 5.0,
    ("pedestrian", "bicycle"): 2.5,
    ("two_wheeler", "two_wheeler"): 4.0,
    ("two_wheeler", "auto_rickshaw"): 4.5,
    ("two_wheeler", "bus"): 6.0,
    ("two_wheeler", "truck"): 6.0,
    ("two_wheeler", "bicycle"): 3.0,
    ("auto_rickshaw", "auto_rickshaw"): 5.0,
    ("auto_rickshaw", "bus"): 6.0,
    ("auto_rickshaw", "truck"): 6.0,
    ("auto_rickshaw", "bicycle"): 3.5,
    ("bus", "bus"): 8.0,
    ("bus", "truck"): 8.0,
    ("bus", "bicycle"): 4.5,
    ("truck", "truck"): 8.0,
    ("truck", "bicycle"): 4.5,
    ("bicycle", "bicycle"): 2.5,
}

NODE_FEATURES = ["x", "y", "vx", "vy", "speed", "ax", "ay", "accel_mag", "sin_heading", "cos_heading", "size_prior"]

EDGE_FEATURES = [
    "dx", "dy", "distance", "dvx", "dvy", "relative_speed", "closing_speed", "bearing_sin", "bearing_cos",
    "rel_heading_sin", "rel_heading_cos", "ttc", "same_class", "size_src", "size_dst",
]

#: Channels of an edge that change sign when its direction is reversed.
ODD_EDGE_FEATURES = ["dx", "dy", "dvx", "dvy", "bearing_sin", "bearing_cos", "rel_heading_sin"]

NODE_BLOCKS = {
    "position": ["x", "y"],
    "kinematic": ["vx", "vy", "speed", "ax", "ay", "accel_mag", "sin_heading", "cos_heading"],
    "heading": ["sin_heading", "cos_heading"],
}
EDGE_BLOCKS = {
    "distance": ["distance"],
    "kinematics": ["dx", "dy", "distance", "dvx", "dvy", "relative_speed", "closing_speed", "ttc"],
    "angles": ["bearing_sin", "bearing_cos", "rel_heading_sin", "rel_heading_cos"],
    "risk": ["distance", "relative_speed", "closing_speed", "ttc", "same_class", "size_src", "size_dst"],
}
#: Order of the twelve channels that the plain export keeps.
EXPORT_EDGE_FEATURES = [
    "dx", "dy", "distance", "dvx", "dvy", "relative_speed", "closing_speed", "ttc", "bearing_cos", "bearing_sin", "rel_heading_cos", "rel_heading_sin",
]
EXPORT_NODE_WIDTH = 12


def node_feature_dim(classes: list[str] | None = None) -> int:
    return len(NODE_FEATURES) + len(ACTOR_CLASSES if classes is None else classes)


def edge_feature_dim() -> int:
    return len(EDGE_FEATURES)


def class_slice(classes: list[str] | None = None) -> slice:
    return slice(len(NODE_FEATURES), node_feature_dim(classes))


def node_feature_index(name: str) -> int:
    if name not in NODE_FEATURES:
        raise KeyError(f"unknown node feature {name!r}; valid: {NODE_FEATURES}")
    return NODE_FEATURES.index(name)


def edge_feature_index(name: str) -> int:
    if name not in EDGE_FEATURES:
        raise KeyError(f"unknown edge feature {name!r}; valid: {EDGE_FEATURES}")
    return EDGE_FEATURES.index(name)
