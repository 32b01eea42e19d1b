"""Plane, box, segment and camera arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.numeric import clip


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for left, right in zip(a[1:], b[1:]):
        total = total + left * right
    return total


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


# Boxes ---------------------------------------------------------------------------------------


def touches_border(x: Column, y: Column, w: Column, h: Column, width: int, height: int, margin: int) -> Column:
    return (x <= margin) | (y <= margin) | (x + w >= width - margin) | (y + h >= height - margin)


def bbox_gap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distance between two (x, y, w, h) boxes; 0 when they touch or overlap."""
    dx = F.greatest(b[0] - (a[0] + a[2]), a[0] - (b[0] + b[2]), F.lit(0.0))
    dy = F.greatest(b[1] - (a[1] + a[3]), a[1] - (b[1] + b[3]), F.lit(0.0))
    return F.hypot(dx, dy)


def bbox_overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Shared area over the smaller area; 0 when a box is empty."""
    wide = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    shared = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    smaller = F.least(a[2] * a[3], b[2] * b[3])
    return F.when(smaller <= 1e-6, F.lit(0.0)).otherwise(shared / smaller)


def bbox_rescale(box: Sequence[Column], scale: float) -> list[Column]:
    return [F.bround(v / float(scale), 0).cast("int") for v in box]


# Cameras -------------------------------------------------------------------------------------


def backproject(u: Column, v: Column, depth: Column, fx, fy, cx, cy) -> list[Column]:
    return [(u - lit(cx)) * depth / lit(fx), (v - lit(cy)) * depth / lit(fy), depth]


def project(x: Column, y: Column, z: Column, fx, fy, cx, cy) -> list[Column]:
    """Pixel of a point; null for a point at or behind the camera."""
    ahead = z > 0
    return [F.when(ahead, x * lit(fx) / z + lit(cx)), F.when(ahead, y * lit(fy) / z + lit(cy))]


def rigid_transform(point: Sequence[Column], matrix: Sequence[Sequence[float]]) -> list[Column]:
    """Point times a 3x4 or 4x4 row-major matrix."""
    return [dot(point, [lit(v) for v in row[:3]]) + lit(row[3]) for row in matrix[:3]]


def signed_distance(point: Sequence[Column], normal: Sequence, offset) -> Column:
    return dot(point, [lit(v) for v in normal]) + lit(offset)


def height_above_plane(u: Column, v: Column, depth: Column, intrinsics: dict, normal: Sequence, offset) -> Column:
    """Signed distance of a depth pixel to the plane, positive towards the camera."""
    ray = backproject(u, v, depth, intrinsics["fx"], intrinsics["fy"], intrinsics["cx"], intrinsics["cy"])
    return signed_distance(ray, normal, offset)


def pixel_to_mm(x: Column, y: Column, *, width_mm=160.0, height_mm=160.0, width_px=800, height_px=800) -> list[Column]:
    """Tray position of a rectified pixel; y points up."""
    return [
        x * float(width_mm) / float(max(1, width_px - 1)),
        (float(height_px - 1) - y) * float(height_mm) / float(max(1, height_px - 1)),
    ]


def homography(x: Column, y: Column, matrix: Sequence[Sequence[float]]) -> list[Column]:
    rows = [dot([x, y, F.lit(1.0)], [lit(v) for v in row]) for row in matrix]
    return [rows[0] / rows[2], rows[1] / rows[2]]


def resize_intrinsics(width: Column, height: Column, fx: Column, fy: Column, cx: Column, cy: Column, scale: float) -> dict[str, Column]:
    """Intrinsics of an image resized by ``scale`` (pixel centres at .5)."""
    if not 0 < scale <= 1:
        raise ValueError("scale must be in (0, 1]")
    s = float(scale)
    return {
        "width": F.greatest(F.lit(1), F.bround(width * s, 0).cast("int")),
        "height": F.greatest(F.lit(1), F.bround(height * s, 0).cast("int")),
        "fx": fx * s,
        "fy": fy * s,
        "cx": (cx + 0.5) * s - 0.5,
        "cy": (cy + 0.5) * s - 0.5,
    }


def rotation_to_quaternion(m: Sequence[Sequence[Column]]) -> Column:
    """Unit quaternion (x, y, z, w) of a rotation matrix; the largest diagonal picks the branch."""
    trace = m[0][0] + m[1][1] + m[2][2]
    largest = F.greatest(m[0][0], m[1][1], m[2][2])

    def root(value: Column) -> Column:
        return F.sqrt(F.greatest(value, F.lit(0.0))) * 2.0

    def anti(i: int, j: int) -> Column:
        return m[i][j] - m[j][i]

    def sym(i: int, j: int) -> Column:
        return m[i][j] + m[j][i]

    by_trace = root(trace + 1.0)
    per_axis = []
    for axis in range(3):
        j, k = (axis + 1) % 3, (axis + 2) % 3
        s = root(1.0 + m[axis][axis] - m[j][j] - m[k][k])
        parts = [None, None, None]
        parts[axis] = s * 0.25
        parts[j] = sym(axis, j) / s
        parts[k] = sym(axis, k) / s
        per_axis.append((*parts, anti(k, j) / s))
    zero = (anti(2, 1) / by_trace, anti(0, 2) / by_trace, anti(1, 0) / by_trace, by_trace * 0.25)
    raw = []
    for i in range(4):
        raw.append(
            F.when(trace > 0, zero[i])
            .when(m[0][0] == largest, per_axis[0][i])
            .when(m[1][1] == largest, per_axis[1][i])
            .otherwise(per_axis[2][i])
        )
    norm = F.greatest(F.sqrt(dot(raw, raw)), F.lit(1e-12))
    return F.struct(*[(r / norm).alias(n) for r, n in zip(raw, ("x", "y", "z", "w"))])


# Segments (x1, y1, x2, y2) ----------------------------------------------------------------------


def seg_length(s: Sequence[Column]) -> Column:
    return F.hypot(s[2] - s[0], s[3] - s[1])


def seg_angle(s: Sequence[Column]) -> Column:
    """Undirected angle in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(s[3] - s[1], s[2] - s[0])), F.lit(180.0))


def angle_difference(a: Column, b: Column) -> Column:
    gap = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(gap, 180.0 - gap)


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def point_line_distance(px: Column, py: Column, s: Sequence[Column]) -> Column:
    dx, dy = s[2] - s[0], s[3] - s[1]
    return F.abs(cross(dx, dy, px - s[0], py - s[1])) / F.greatest(F.hypot(dx, dy), F.lit(1e-6))


def along_segment(px: Column, py: Column, s: Sequence[Column]) -> Column:
    """Position of the foot point, 0 at the start and 1 at the end."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    return ((px - s[0]) * dx + (py - s[1]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9))


def projection_gap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Gap between two segments projected on the first one's direction."""
    length = F.greatest(seg_length(a), F.lit(1e-6))
    dx, dy = (a[2] - a[0]) / length, (a[3] - a[1]) / length
    a1 = (a[2] - a[0]) * dx + (a[3] - a[1]) * dy
    b0 = (b[0] - a[0]) * dx + (b[1] - a[1]) * dy
    b1 = (b[2] - a[0]) * dx + (b[3] - a[1]) * dy
    zero = F.lit(0.0)
    return F.greatest(F.least(zero, a1) - F.greatest(b0, b1), F.least(b0, b1) - F.greatest(zero, a1), zero)


def segment_intersection(a: Sequence[Column], b: Sequence[Column], extension: Column | float) -> Column:
    """Crossing point of two segments that may be extended by ``extension`` at each end, or null."""
    rx, ry, sx, sy = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    qx, qy = b[0] - a[0], b[1] - a[1]
    denominator = cross(rx, ry, sx, sy)
    t, u = cross(qx, qy, sx, sy) / denominator, cross(qx, qy, rx, ry) / denominator
    more_a = lit(extension) / F.greatest(seg_length(a), F.lit(1e-6))
    more_b = lit(extension) / F.greatest(seg_length(b), F.lit(1e-6))
    crosses = (F.abs(denominator) >= 1e-5) & t.between(-more_a, 1.0 + more_a) & u.between(-more_b, 1.0 + more_b)
    return F.when(crosses, F.struct((a[0] + t * rx).alias("x"), (a[1] + t * ry).alias("y")))


def line_contains(line: Sequence[Column], edge: Sequence[Column], tolerance: float = 3.0) -> Column:
    """Whether both ends of an edge lie on a line at least 8 long and cover half of it."""
    first, second = along_segment(edge[0], edge[1], line), along_segment(edge[2], edge[3], line)
    long_enough = (line[2] - line[0]) ** 2 + (line[3] - line[1]) ** 2 >= 64
    near = F.greatest(
        point_line_distance(edge[0], edge[1], line), point_line_distance(edge[2], edge[3], line)
    ) <= tolerance
    inside = (F.least(first, second) >= -0.1) & (F.greatest(first, second) <= 1.1)
    return long_enough & near & inside & (F.abs(first - second) >= 0.5)


def direction_entropy(counts: Sequence[Column]) -> Column:
    """Entropy of a 12-bin direction histogram, 0 (one direction) to 1 (all alike)."""
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    out = None
    for c in counts:
        p = c / F.greatest(total.cast("double"), F.lit(1.0))
        term = p * F.ln(p + 1e-12)
        out = term if out is None else out + term
    return -out / F.ln(F.lit(12.0))


def direction_bin(angle: Column, bins: int = 12) -> Column:
    return F.least(F.floor(angle / (180.0 / bins)), F.lit(bins - 1)).cast("int")


# Colours -------------------------------------------------------------------------------------


def hex_to_rgb(value: Column) -> list[Column]:
    digits = F.regexp_replace(value, "^#", "")
    return [F.conv(F.substring(digits, 1 + 2 * i, 2), 16, 10).cast("int") for i in range(3)]


def srgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIE Lab (D65) of 8-bit sRGB, in natural units."""

    def linear(c: Column) -> Column:
        s = c / 255.0
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    def curve(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = curve((0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456)
    y = curve(0.212671 * lr + 0.715160 * lg + 0.072169 * lb)
    z = curve((0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754)
    return [116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)]


def bgr_to_hsv(b: Column, g: Column, r: Column) -> list[Column]:
    """8-bit HSV with hue in 0..179 (degrees over two) and saturation, value in 0..255."""
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    span = (high - low).cast("double")
    hue = (
        F.when(span == 0, F.lit(0.0))
        .when(high == r, 60.0 * (g - b) / span)
        .when(high == g, 120.0 + 60.0 * (b - r) / span)
        .otherwise(240.0 + 60.0 * (r - g) / span)
    )
    half = F.bround(F.pmod(hue, F.lit(360.0)) / 2.0, 0).cast("int")
    saturation = F.when(high == 0, F.lit(0.0)).otherwise(255.0 * span / high)
    return [half % 180, F.bround(saturation, 0).cast("int"), high.cast("int")]


# Grasps and confidences ------------------------------------------------------------------------


def grasp_score(
    rmse: Column, tilt_deg: Column, valid_ratio: Column, edge_mm: Column,
    *, max_rmse: float = 1.2, max_tilt: float = 35.0, cup_mm: float = 15.0, margin_mm: float = 2.0,
) -> Column:
    flat = F.greatest(F.lit(0.0), 1.0 - rmse / max_rmse)
    tilt = F.greatest(F.lit(0.0), 1.0 - tilt_deg / max_tilt)
    edge = clip((edge_mm - cup_mm / 2.0) / max(1.0, margin_mm * 3.0), 0.0, 1.0)
    return 0.35 * flat + 0.25 * tilt + 0.2 * valid_ratio + 0.2 * edge


def grasp_allowed(
    rmse: Column, tilt_deg: Column, valid_ratio: Column,
    *, max_rmse: float = 1.2, max_tilt: float = 35.0, min_valid: float = 0.9,
) -> Column:
    return (rmse <= max_rmse) & (tilt_deg <= max_tilt) & (valid_ratio >= min_valid)


def side_quality(
    visible: Column, pixels: Column, blur: Column, support: Column, reason: Column,
    *, min_area: float = 120.0, min_blur: float = 35.0, full_support: float = 0.65,
) -> Column:
    weakest = F.least(
        visible,
        clip(pixels / max(min_area, 1.0), 0.0, 1.0),
        clip(blur / max(min_blur, 1e-6), 0.0, 1.0),
        clip(support / full_support, 0.0, 1.0),
    )
    return F.when(reason == "accepted", weakest).otherwise(F.lit(0.0))


def side_quality_weighted(mask_ratio: Column, blur: Column, solidity: Column) -> Column:
    return clip(
        0.45 * clip(mask_ratio / 0.003, 0.0, 1.0)
        + 0.35 * clip(blur / 120.0, 0.0, 1.0)
        + 0.20 * clip(solidity, 0.0, 1.0),
        0.0,
        1.0,
    )


def colour_confidence(distance: Column, separation: Column, max_distance: float = 48.0) -> Column:
    near = F.greatest(F.lit(0.0), 1.0 - distance / max_distance)
    return clip(0.75 * near + 0.25 * clip(separation / 25.0, 0.0, 1.0), 0.0, 1.0)


def knn_confidence(distance: Column, threshold: Column, margin: Column) -> Column:
    return clip(
        0.72 * F.exp(-((distance / threshold) ** 2)) + 0.28 * clip(margin / 0.35, 0.0, 1.0), 0.0, 1.0
    )


def class_threshold_confidence(distance: Column, threshold: Column) -> Column:
    return 0.78 + 0.21 * clip(1.0 - distance / F.greatest(threshold, F.lit(1e-6)), 0.0, 1.0)


def prototype_confidence(distance: Column, threshold: float = 0.65) -> Column:
    return clip(0.8 + 0.19 * (1.0 - distance / threshold), 0.0, 0.99)


def hybrid_vote(
    label: Column, confidence: Column, base_label: Column, base_confidence: Column,
    extent_short: Column, extent_long: Column, near_surface: Column,
    *, weight: float = 0.8, disagree_below: float = 0.8,
) -> Column:
    """Model and rule-based label joined: a weak model that disagrees with the rules gives ``unknown``.

    A broad flat body called an octahedron is a hexagonal prism lying on its side.
    """
    given = clip(confidence, 0.0, 1.0)
    override = (label == "octahedron") & (extent_short >= 35.0) & (extent_long >= 42.0) & (near_surface >= 0.35)
    used = F.when(override, F.lit("hexagonal_prism")).otherwise(label)
    strong = F.when(override, F.greatest(given, F.lit(0.86))).otherwise(given)
    agrees = used == base_label
    fused = weight * strong + F.when(agrees, (1.0 - weight) * base_confidence).otherwise(F.lit(0.0))
    refused = ~agrees & (strong < disagree_below)
    return F.struct(
        F.when(refused, F.lit("unknown")).otherwise(used).alias("label"),
        clip(fused, 0.0, 1.0).alias("confidence"),
        override.alias("override"),
    )


def primitive_shape(
    points: Column, vertices: Column, circularity: Column, rmse: Column, curvature: Column, silhouette: Column
) -> Column:
    """Rule tree over surface features: (label, confidence)."""

    def leaf(name: str | Column, confidence: Column | float) -> Column:
        label = F.lit(name) if isinstance(name, str) else name
        return F.struct(label.alias("label"), lit(confidence).alias("confidence"))

    curved = (rmse >= 1.0) | (curvature >= 0.0015)
    round_body = leaf(
        F.when(curved, "sphere").otherwise("cylinder"), 0.82 + 0.16 * F.least(F.lit(1.0), F.abs(rmse - 1.0) / 2.0)
    )
    box = leaf(
        F.when(silhouette >= 0.82, "cube").otherwise("cuboid"),
        0.82 + 0.15 * F.least(F.lit(1.0), F.abs(silhouette - 0.82) / 0.3),
    )
    return (
        F.when(points < 40, leaf("unknown", 0.0))
        .when((circularity >= 0.78) & (vertices >= 7), round_body)
        .when(vertices == 3, leaf("triangular_prism", 0.86))
        .when((vertices == 4) & (circularity < 0.68) & (silhouette > 0.75), leaf("triangular_prism", 0.78))
        .when(vertices == 4, box)
        .when(vertices == 5, leaf("pentagonal_prism", 0.84))
        .when(vertices == 6, leaf("hexagonal_prism", 0.84))
        .otherwise(leaf("unknown", 0.35))
    )


def polygon_shape(vertices: Column, circularity: Column, aspect: Column, solidity: Column) -> Column:
    """Rule tree over outline features: (label, confidence)."""

    def leaf(name: str, confidence: Column) -> Column:
        return F.struct(F.lit(name).alias("label"), confidence.alias("confidence"))

    one = F.lit(1.0)
    return (
        F.when((circularity >= 0.82) & (vertices >= 7), leaf("circle", F.least(one, circularity)))
        .when(vertices == 3, leaf("triangle", 0.9 * solidity))
        .when(
            (vertices == 4) & (aspect >= 0.84),
            leaf("square", (0.78 + 0.22 * F.least(one, (aspect - 0.84) / 0.16)) * solidity),
        )
        .when(vertices == 4, leaf("rectangle", (0.8 + 0.2 * F.least(one, (0.84 - aspect) / 0.35)) * solidity))
        .when(vertices == 5, leaf("pentagon", 0.88 * solidity))
        .when(vertices == 6, leaf("hexagon", 0.88 * solidity))
        .otherwise(leaf("unknown", 0.35 * solidity))
    )


def evidence_quality(
    lines: Column, mean_support: Column, junctions: Column, faces: Column, colour_support: Column | None = None
) -> Column:
    """Weighted evidence of an edge topology in [0, 1]; with colour support the weights change."""
    one = F.lit(1.0)
    line = F.least(lines / 4.0, one)
    junction = F.least(junctions / 2.0, one)
    face = F.least(F.greatest(faces - 1, F.lit(0)) / 3.0, one)
    if colour_support is None:
        total = 0.45 * line + 0.25 * mean_support + 0.2 * junction + 0.1 * face
    else:
        total = 0.30 * line + 0.20 * mean_support + 0.15 * junction + 0.15 * face + 0.20 * colour_support
    return clip(total, 0.0, 1.0)


def evidence_reason(lines: Column, quality: Column) -> Column:
    return F.when((lines >= 2) & (quality >= 0.42), "accepted").otherwise("edge_evidence_low")


def principal_angle(cov_xx: Column, cov_yy: Column, cov_xy: Column) -> Column:
    """Main axis angle in [-90, 90) from second moments; image y points down, the angle's y up."""
    return F.pmod(F.degrees(0.5 * F.atan2(-2.0 * cov_xy, cov_xx - cov_yy)) + 90.0, F.lit(180.0)) - 90.0


# Convex polygons: arrays of corners (x, y) in order, in either sense ----------------------------------


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _next(items: Column, i: Column) -> Column:
    return F.get(items, (i + 1) % F.size(items))


def signed_area(polygon: Column) -> Column:
    """Half the sum of cross products of neighbouring corners; positive when they turn from x to y."""

    def area(corners: Column) -> Column:
        turned = F.transform(corners, lambda p, i: cross(p["x"], p["y"], _next(corners, i)["x"], _next(corners, i)["y"]))
        return F.aggregate(turned, F.lit(0.0), lambda t, c: t + c) / 2

    return _bound(polygon, area)


def _cut(polygon: Column, edge: Column) -> Column:
    """What of a polygon lies on the inner side of a line: corners inside, and where its edges cross the line."""
    a, b = edge["a"], edge["b"]

    def measured(p: Column) -> Column:
        side = edge["sense"] * cross(b["x"] - a["x"], b["y"] - a["y"], p["x"] - a["x"], p["y"] - a["y"])
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), side.alias("side"))

    def crossing(p: Column, q: Column) -> Column:
        share = p["side"] / (p["side"] - q["side"])
        return F.struct((p["x"] + (q["x"] - p["x"]) * share).alias("x"), (p["y"] + (q["y"] - p["y"]) * share).alias("y"))

    def kept(corners: Column) -> Column:
        def of(p: Column, i: Column) -> Column:
            corner = F.when(p["side"] >= 0, F.struct(p["x"].alias("x"), p["y"].alias("y")))
            met = _bound(_next(corners, i), lambda q: F.when(p["side"] * q["side"] < 0, crossing(p, q)))
            return F.filter(F.array(corner, met), lambda e: e.isNotNull())

        return F.flatten(F.transform(corners, of))

    return _bound(F.transform(polygon, measured), kept)


def clipped_polygon(polygon: Column, clipper: Column) -> Column:
    """The common part of two convex polygons: one is cut at each edge of the other in turn."""
    sense = F.when(signed_area(clipper) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))

    def edges(turn: Column) -> Column:
        return F.transform(clipper, lambda p, i: F.struct(p.alias("a"), _next(clipper, i).alias("b"), turn.alias("sense")))

    return F.aggregate(_bound(sense, edges), polygon, _cut)


def polygon_overlap(a: Column, b: Column) -> Column:
    """Common area over the smaller area; none where an area is zero."""
    smaller = F.least(F.abs(signed_area(a)), F.abs(signed_area(b)))
    return _bound(smaller, lambda s: F.when(s > 1e-6, F.abs(signed_area(clipped_polygon(a, b))) / s).otherwise(F.lit(0.0)))


def turned_box(x: Column, y: Column, w: Column, h: Column, angle: Column) -> Column:
    """Corners of a box turned about its centre."""
    u, v = x + w / 2, y + h / 2
    cos, sin = F.cos(angle), F.sin(angle)
    corners = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]
    return F.array(*[
        F.struct((u + a * w * cos - b * h * sin).alias("x"), (v + a * w * sin + b * h * cos).alias("y")) for a, b in corners
    ])
