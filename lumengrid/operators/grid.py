"""Operations on images kept as tiles, where a tile needs its neighbours.

A tile table has one row per tile, without halos: image_id, rows, cols (of the
image), ty, tx (the tile's first pixel), shape, img.  Tiles start at multiples
of ``side``.  Four mechanisms, each a bounded exchange between tiles:

- ``stencil``: every tile sends the pixels that lie in its neighbours' halos
  (or that the boundary mode shows there), then a kernel runs on each window.
- ``reconstruct``: fixpoints.  Tiles exchange their frames only; a tile runs
  again when a frame beside it could raise one of its own border pixels.
- ``gather``: output tiles name the source tiles that their inverse image
  draws on, one equi-join brings them.
- ``spline_filter``: recursions along lines.  A tile sends its end states; they
  are scanned along each line of tiles and handed back as starting states.

No step holds an image, only tiles; hot keys don't occur, since what a tile
receives is bounded by its size and the mode.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import filters, interpolate
from .runtime import STACK, _lists, scratch, ship

KEY = ["image_id", "ty", "tx"]
PLACE = ["image_id", "rows", "cols", "ty", "tx"]
DOUBLES, INTS = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())


def stage(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    (df.sortWithinPartitions(*order) if order else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _schema(tiles: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The tile's place, with image_id of the table's own type, and further fields."""
    return T.StructType([tiles.schema["image_id"], *[T.StructField(c, T.IntegerType()) for c in PLACE[1:]], *[T.StructField(c, t) for c, t in fields]])


def arrays(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of numpy arrays."""
    ends = np.cumsum([0, *[v.size for v in values]]).astype(np.int32)
    flat = np.concatenate([np.zeros(0), *[np.ravel(v) for v in values]]) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def _rows(batch: pa.RecordBatch, *columns: str):
    """The batch's rows: (place, values of the columns); list values are numpy arrays."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    data = []
    for c in columns:
        column = get(c)
        if pa.types.is_list(column.type):
            v, o = _lists(column)
            data.append([v[i:j] for i, j in zip(o[:-1].tolist(), o[1:].tolist())])
        else:
            data.append(column.to_pylist())
    return zip(zip(*[get(c).to_pylist() for c in PLACE]), zip(*data) if data else itertools.repeat(()))


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return arrays(values, kind.value_type) if pa.types.is_list(kind) else pa.array(values, kind)


def _packed(rows: Iterator[tuple], form: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (tuples, lists as numpy arrays) in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(v.size for v in row if isinstance(v, np.ndarray))
        if size >= STACK or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([_column(list(c), f.type) for c, f in zip(zip(*held), form)], schema=form)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([_column(list(c), f.type) for c, f in zip(zip(*held), form)], schema=form)


def mapped(df: DataFrame, run: Callable, schema: T.StructType, *columns: str) -> DataFrame:
    """``run`` turns an iterator of rows into an iterator of rows; no shuffle."""
    ship(df.sparkSession)
    form = to_arrow_schema(schema)
    picked = df.select(*PLACE, *columns)
    return picked.mapInArrow(lambda batches: _packed(run(row for batch in batches for row in _rows(batch, *columns)), form), schema)


def merged(df: DataFrame, run: Callable, schema: T.StructType, *columns: str, keys: list[str] = KEY, order: list[str] = []) -> DataFrame:
    """``run`` turns an iterator of groups (lists of rows with equal keys, in order) into an iterator of rows; one shuffle.

    A group is held by its task, so groups must be bounded.  Rows with a null key are left out.
    """
    ship(df.sparkSession)
    form = to_arrow_schema(schema)
    at = [(0, PLACE.index(k)) if k in PLACE else (1, columns.index(k)) for k in keys]
    sorted_ = df.where(" and ".join(f"{k} is not null" for k in keys)).select(*PLACE, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)

    def go(batches):
        rows = (row for batch in batches for row in _rows(batch, *columns))
        return _packed(run(list(g) for _, g in itertools.groupby(rows, lambda r: [r[i][j] for i, j in at])), form)

    return sorted_.mapInArrow(go, schema)


def _size(place: tuple, side: int) -> tuple[int, int]:
    """Height and width of a tile."""
    _, rows, cols, ty, tx = place
    return min(side, rows - ty), min(side, cols - tx)


# Sources ------------------------------------------------------------------------------------


def split(images: DataFrame, side: int) -> DataFrame:
    """2-D images, each in one row, to tiles; a null image, or one whose values don't fill its shape, has none."""
    from .runtime import stacks

    ship(images.sparkSession)
    picked = images.select("image_id", F.col("shape").cast("array<int>").alias("shape"), F.col("img").cast("array<double>").alias("img"))
    schema = _schema(picked, ("shape", INTS), ("img", DOUBLES))
    form = to_arrow_schema(schema)

    def cut_up(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for cut, stack in stacks(batch.column(1), batch.column(2)):
                if stack is None or stack.ndim != 3:
                    continue
                _, rows, cols = stack.shape
                for image, x in zip(ids[cut], stack):
                    for ty in range(0, rows, side):
                        for tx in range(0, cols, side):
                            part = x[ty : ty + side, tx : tx + side]
                            yield image, rows, cols, ty, tx, np.array(part.shape), part

    return picked.mapInArrow(lambda batches: _packed(cut_up(batches), form), schema)


def write_rasters(images: DataFrame, folder: str | None = None) -> DataFrame:
    """Images to raw files of doubles in row order, a file per task; returns image_id, file, start (bytes), rows, cols, dtype."""
    from pyarrow import fs

    from .runtime import stacks

    spark = images.sparkSession
    ship(spark)
    folder = folder or scratch(spark)
    picked = images.select("image_id", F.col("shape").cast("array<int>").alias("shape"), F.col("img").cast("array<double>").alias("img"))

    def run(batches):
        import uuid

        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.raw", 0, None
        found = []
        for batch in batches:
            for cut, stack in stacks(batch.column(1), batch.column(2)):
                if stack is None or stack.ndim != 3:
                    continue
                out = out or files.open_output_stream(f"{path}/{name}")
                for k, image in enumerate(stack):
                    raw = image.astype("<f8").tobytes()
                    out.write(raw)
                    found.append({"image_id": batch.column(0)[cut.start + k].as_py(), "file": f"{folder}/{name}", "start": at, "rows": image.shape[0], "cols": image.shape[1], "dtype": "<f8"})
                    at += len(raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(found, pa.schema([("image_id", batch.column(0).type), ("file", pa.string()), ("start", pa.int64()), ("rows", pa.int32()), ("cols", pa.int32()), ("dtype", pa.string())]))

    schema = T.StructType([picked.schema["image_id"]]).add("file", "string").add("start", "long").add("rows", "integer").add("cols", "integer").add("dtype", "string")
    return stage(picked.mapInArrow(run, schema))


def read_rasters(rasters: DataFrame, side: int) -> DataFrame:
    """Tiles of raw files (image_id, file, start, rows, cols, dtype), read by byte ranges: no task holds more than a tile.

    Files are any that Arrow's file systems open; a file that is too short
    fails the read.
    """
    from pyarrow import fs

    ship(rasters.sparkSession)
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(side)))
    places = rasters.where("rows > 0 and cols > 0").withColumn("ty", steps("rows")).withColumn("tx", steps("cols"))
    places = places.select(*PLACE, "file", "start", "dtype").repartition("file", "ty", "tx")

    def run(rows_):
        opened: dict = {}
        for place, (name, start, dtype) in rows_:
            if name not in opened:
                opened.clear()
                files, path = fs.FileSystem.from_uri(name)
                opened[name] = files.open_input_file(path)
            kind, (h, w), (_, _, cols, ty, tx) = np.dtype(dtype), _size(place, side), place
            raw = b"".join(opened[name].read_at(w * kind.itemsize, start + ((ty + r) * cols + tx) * kind.itemsize) for r in range(h))
            yield *place, np.array([h, w]), np.frombuffer(raw, kind).astype(float).reshape(h, w)

    return mapped(places, run, _schema(places, ("shape", INTS), ("img", DOUBLES)), "file", "start", "dtype")


def tiles_of_pixels(px: DataFrame, side: int, value: str = "v", fill: float = 0.0) -> DataFrame:
    """Tiles of a pixel table (image_id, rows, cols, y, x, value); pixels not given are ``fill``.

    Only tiles with a pixel exist; a pixel outside its image is left out.
    """
    base = lambda c: (F.floor(F.col(c) / side) * side).cast("int")
    inside = px.where("y >= 0 and x >= 0 and y < rows and x < cols")
    placed = inside.select("image_id", F.col("rows").cast("int").alias("rows"), F.col("cols").cast("int").alias("cols"), base("y").alias("ty"), base("x").alias("tx"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias("v"))

    def run(groups):
        for group in groups:
            place = group[0][0]
            tile = np.full(_size(place, side), fill)
            y, x, v = (np.array(c) for c in zip(*[data for _, data in group]))
            tile[y.astype(int) - place[3], x.astype(int) - place[4]] = v
            yield *place, np.array(tile.shape), tile

    return merged(placed, run, _schema(placed, ("shape", INTS), ("img", DOUBLES)), "y", "x", "v")


# Halo exchange -----------------------------------------------------------------------------


@functools.lru_cache(1 << 14)
def feeds(n: int, side: int, lo: int, hi: int, mode: str, start: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Along one axis of length n: (tile, places in its window, own rows) for every tile whose window shows rows of the one at ``start``.

    A window reaches ``lo`` rows before its tile and ``hi`` behind.
    """
    stop, last = min(start + side, n), (n - 1) // side
    ahead, behind = np.arange(-lo, 0), np.arange(n, n + hi)
    at = np.concatenate([ahead, np.arange(start, stop), behind])
    source = np.concatenate([filters.boundary_at(ahead, n, mode), np.arange(start, stop), filters.boundary_at(behind, n, mode)])
    own = (source >= start) & (source < stop)
    at, source = at[own], source[own] - start
    near = set(range(max(0, (start - hi) // side), min(last, (stop - 1 + lo) // side) + 1))
    if len(at) and at.min() < 0:
        near |= set(range(0, min(last, lo // side) + 1))
    if len(at) and at.max() >= n:
        near |= set(range(max(0, (n - hi) // side), last + 1))
    out = []
    for tile in sorted(near):
        a, b = tile * side - lo, min((tile + 1) * side, n) + hi
        pick = (at >= a) & (at < b)
        if pick.any():
            out.append((tile * side, (at[pick] - a).astype(np.int32), source[pick].astype(np.int32)))
    return out


def windows(tiles: DataFrame, side: int, halo: tuple[int, int], mode: str, columns: list[str] = ["img"]) -> DataFrame:
    """Pieces of windows: the place of the tile that receives them, where they go (ys, xs), and the values of each column."""
    lo, hi = halo

    def run(rows_):
        for place, data in rows_:
            image, rows, cols, ty, tx = place
            h, w = _size(place, side)
            if any(v.size != h * w for v in data):
                continue
            data = [v.reshape(h, w) for v in data]
            for dy, to_y, from_y in feeds(rows, side, lo, hi, mode, ty):
                for dx, to_x, from_x in feeds(cols, side, lo, hi, mode, tx):
                    yield image, rows, cols, dy, dx, to_y, to_x, *[v[from_y[:, None], from_x] for v in data]

    return mapped(tiles, run, _schema(tiles, ("ys", INTS), ("xs", INTS), *[(c, DOUBLES) for c in columns]), *columns)


def stencil(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], halo: int, side: int, mode: str = "reflect", cval: float = 0.0) -> DataFrame:
    """A kernel that looks ``halo`` pixels far, on tiles: the same as on the whole image, for any boundary mode and halo.

    The kernel takes a stack of windows and returns one of the same shape; the
    outer ``halo`` pixels of its result are cut off.  One shuffle, of the tiles
    and their strips.
    """
    pieces = windows(tiles, side, (halo, halo), mode)

    def results(shape, held):
        stack = np.asarray(kernel(np.stack([w for _, w in held])), float)
        for (place, _), core in zip(held, stack[:, halo : shape[0] - halo, halo : shape[1] - halo]):
            yield *place, np.array(core.shape), core

    def run(groups):
        waiting: dict[tuple, list] = {}
        size = 0
        for group in groups:
            place = group[0][0]
            h, w = _size(place, side)
            window = np.full((h + 2 * halo, w + 2 * halo), cval)
            for _, (ys, xs, v) in group:
                window[ys[:, None], xs] = v.reshape(len(ys), len(xs))
            waiting.setdefault(window.shape, []).append((place, window))
            size += window.size
            if size >= STACK:
                for shape, held in waiting.items():
                    yield from results(shape, held)
                waiting, size = {}, 0
        for shape, held in waiting.items():
            yield from results(shape, held)

    return merged(pieces, run, _schema(tiles, ("shape", INTS), ("img", DOUBLES)), "ys", "xs", "img")


# Fixpoints ---------------------------------------------------------------------------------


def _grow(x: np.ndarray, mask: np.ndarray, connectivity: int) -> np.ndarray:
    """For each of a stack, the greatest image below the mask that spreads from x: dilations until nothing changes."""
    now = np.minimum(x, mask)
    foot = np.ones((3, 3), bool) if connectivity > 1 else np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
    open_ = np.arange(len(now))
    while len(open_):
        new = np.minimum(filters.maximum_filter(now[open_], footprint=foot, mode="nearest"), mask[open_])
        moved = (new != now[open_]).any((1, 2))
        now[open_] = new
        open_ = open_[moved]
    return now


def _frame(x: np.ndarray) -> np.ndarray:
    """Top row, bottom row, left and right column, end to end."""
    return np.concatenate([x[0], x[-1], x[:, 0], x[:, -1]])


def _sides(frame: np.ndarray, h: int, w: int) -> list[np.ndarray]:
    return [frame[:w], frame[w : 2 * w], frame[2 * w : 2 * w + h], frame[2 * w + h :]]


def _ring(h: int, w: int, messages) -> np.ndarray:
    """A window of -inf whose outermost pixels hold what the neighbours' frames say; ``messages`` has (dy, dx, values)."""
    out = np.full((h + 2, w + 2), -np.inf)
    place = lambda d, n: 0 if d < 0 else n + 1 if d > 0 else slice(1, n + 1)
    for dy, dx, v in messages:
        out[place(dy, h), place(dx, w)] = v if len(v) > 1 or dy * dx == 0 else v[0]
    return out


def _messages(frames: DataFrame, side: int) -> DataFrame:
    """From each tile's frame, what its eight neighbours see of it (dy, dx: where it lies, seen from them), and the frame itself (0, 0)."""
    def run(rows_):
        for place, (frame, mask) in rows_:
            image, rows, cols, ty, tx = place
            top, bottom, left, right = _sides(frame, *_size(place, side))
            seen = {(-1, -1): top[:1], (-1, 0): top, (-1, 1): top[-1:], (0, -1): left, (0, 1): right, (1, -1): bottom[:1], (1, 0): bottom, (1, 1): bottom[-1:]}
            yield *place, 0, 0, frame, mask
            for (dy, dx), v in seen.items():
                if 0 <= ty + dy * side < rows and 0 <= tx + dx * side < cols:
                    yield image, rows, cols, ty + dy * side, tx + dx * side, -dy, -dx, v, np.zeros(0)

    return mapped(frames, run, _schema(frames, ("dy", T.IntegerType()), ("dx", T.IntegerType()), ("v", DOUBLES), ("mask", DOUBLES)), "frame", "mask_frame")


def _rings(messages: DataFrame, side: int, connectivity: int, active: bool) -> DataFrame:
    """The ring each tile sees; with ``active`` only of tiles one of whose border pixels it would raise."""
    def run(groups):
        for group in groups:
            place = group[0][0]
            h, w = _size(place, side)
            own = [data[2:] for _, data in group if data[0] == data[1] == 0]
            got = [data[:3] for _, data in group if data[0] or data[1]]
            if not own or not got:
                continue
            ring = _ring(h, w, got)
            if active:
                wide = [ring[0], ring[-1], ring[:, 0], ring[:, -1]]
                seen = [np.maximum(np.maximum(e[:-2], e[2:]), e[1:-1]) if connectivity > 1 else e[1:-1] for e in wide]
                if not any((np.minimum(e, m) > v).any() for e, v, m in zip(seen, *[_sides(x, h, w) for x in own[0]])):
                    continue
            yield *place, _frame(ring)

    return merged(messages, run, _schema(messages, ("ring", DOUBLES)), "dy", "dx", "v", "mask")


def _solved(tiles: DataFrame, side: int, connectivity: int, ring: bool, frames: bool) -> DataFrame:
    """Each tile's fixpoint within its ring: its frame and its mask's, or the tile itself."""
    fields = [("frame", DOUBLES), ("mask_frame", DOUBLES)] if frames else [("shape", INTS), ("img", DOUBLES)]

    def results(held):
        tops = np.stack([top for _, _, top in held])
        for (place, _, top), core in zip(held, _grow(np.stack([wide for _, wide, _ in held]), tops, connectivity)[:, 1:-1, 1:-1]):
            yield *place, *((_frame(core), _frame(top[1:-1, 1:-1])) if frames else (np.array(core.shape), core))

    def run(rows_):
        waiting: dict[tuple, list] = {}
        size = 0
        for place, (seed, mask, *edge) in rows_:
            h, w = _size(place, side)
            if seed.size != h * w or mask.size != h * w:
                continue
            wide, top = np.full((h + 2, w + 2), -np.inf), np.full((h + 2, w + 2), -np.inf)
            if edge and edge[0].size:
                for x in (wide, top):
                    x[0], x[-1], x[:, 0], x[:, -1] = _sides(edge[0], h + 2, w + 2)
            top[1:-1, 1:-1] = mask.reshape(h, w)
            wide[1:-1, 1:-1] = np.minimum(seed, mask).reshape(h, w)
            waiting.setdefault(top.shape, []).append((place, wide, top))
            size += top.size
            if size >= STACK:
                for held in waiting.values():
                    yield from results(held)
                waiting, size = {}, 0
        for held in waiting.values():
            yield from results(held)

    return mapped(tiles, run, _schema(tiles, *fields), "img", "mask", *(["ring"] if ring else []))


def _bounds(df: DataFrame) -> str | None:
    """A filter that Parquet can skip row groups by: the range of keys that occur; none for an empty table."""
    low = df.agg(*[f(c).alias(f"{n}_{c}") for c in ("ty", "tx") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return None if low["lo_ty"] is None else f"ty between {low['lo_ty']} and {low['hi_ty']} and tx between {low['lo_tx']} and {low['hi_tx']}"


def reconstruct(tiles: DataFrame, side: int, method: str = "dilation", connectivity: int = 2) -> DataFrame:
    """Grey reconstruction of ``img`` under (erosion: above) the column ``mask``, over whole images kept as tiles.

    Every tile settles by itself first and leaves its frame.  In each round
    tiles that a neighbour's frame would raise settle again with it, starting
    from their own seed, so only frames are state; rounds end when no tile is
    left.  Their number follows the tiles that the longest path crosses.  The
    tiles are written once, in order of place, and read by range of place.
    """
    turn = -1.0 if method == "erosion" else 1.0
    signed = lambda c: F.transform(c, lambda v: v * turn) if turn < 0 else F.col(c)
    base = stage(tiles.select(*PLACE, signed("img").alias("img"), signed("mask").alias("mask")), KEY)
    frames = stage(_solved(base, side, connectivity, False, True))
    while True:
        active = stage(_rings(_messages(frames, side), side, connectivity, True))
        where = _bounds(active)
        if where is None:
            break
        new = stage(_solved(base.where(where).join(active.select(*KEY, "ring"), KEY), side, connectivity, True, True))
        frames = stage(frames.join(new.select(*KEY), KEY, "left_anti").unionByName(new))
    rings = _rings(_messages(frames, side), side, connectivity, False)
    out = _solved(base.join(rings.select(*KEY, "ring"), KEY, "left"), side, connectivity, True, False)
    return out.withColumn("img", signed("img")) if turn < 0 else out


def propagate(tiles: DataFrame, side: int, connectivity: int = 1) -> DataFrame:
    """Binary propagation of ``img`` within ``mask`` (both 0 or 1): seeds outside the mask stay, and feed it."""
    wide = F.zip_with("mask", "img", lambda m, v: F.when((m != 0) | (v != 0), 1.0).otherwise(0.0))
    return reconstruct(tiles.select(*PLACE, F.transform("img", lambda v: F.when(v != 0, 1.0).otherwise(0.0)).alias("img"), wide.alias("mask")), side, "dilation", connectivity)


def fill_holes(tiles: DataFrame, side: int, connectivity: int = 1) -> DataFrame:
    """Binary images with their holes filled: what the background can't reach from the image's edge."""
    off = F.transform("img", lambda v: F.when(v != 0, 0.0).otherwise(1.0))
    h, w = F.least(F.lit(side), F.col("rows") - F.col("ty")), F.least(F.lit(side), F.col("cols") - F.col("tx"))
    y, x = lambda i: F.col("ty") + F.floor(i / w), lambda i: F.col("tx") + i % w
    edge = lambda i: (y(i) == 0) | (x(i) == 0) | (y(i) == F.col("rows") - 1) | (x(i) == F.col("cols") - 1)
    inner = (F.col("ty") > 0) & (F.col("tx") > 0) & (F.col("ty") + h < F.col("rows")) & (F.col("tx") + w < F.col("cols"))
    seed = F.when(inner, F.transform(off, lambda v: F.lit(0.0))).otherwise(F.transform(off, lambda v, i: F.when(edge(i), v).otherwise(0.0)))
    out = reconstruct(tiles.select(*PLACE, seed.alias("img"), off.alias("mask")), side, "dilation", connectivity)
    return out.withColumn("img", F.transform("img", lambda v: 1.0 - v))


def hysteresis(tiles: DataFrame, side: int, low: float, high: float) -> DataFrame:
    """Pixels above ``low`` that hang together with one above ``high``."""
    above = lambda t: F.transform("img", lambda v: F.when(v > t, 1.0).otherwise(0.0))
    return reconstruct(tiles.select(*PLACE, above(max(low, high)).alias("img"), above(low).alias("mask")), side, "dilation", 1)


# Gathers -----------------------------------------------------------------------------------


def gather(tiles: DataFrame, side: int, coords: Callable, output_shape: Callable | tuple[int, int] | None = None, order: int = 1, mode: str = "constant", cval: float = 0.0, prefilter: bool = True) -> DataFrame:
    """Values at real coordinates: ``coords(y, x, rows, cols)`` gives those (row, column) in the source image that output pixels show.

    ``output_shape`` is a shape or a function of (rows, cols).  Output tiles
    work out which source tiles their samples lie in, whatever the map; a join
    on place brings them (a source tile goes to as many output tiles as show
    it), and a second exchange puts them together.  Orders 2 to 5 filter
    splines first.
    """
    pad = 0
    if order > 1 and prefilter:
        if mode in interpolate._PAD:
            pad = interpolate._PAD[mode]
            tiles = padded(tiles, side, pad, "nearest" if mode == "nearest" else "constant", cval)
        tiles = spline_filter(tiles, side, order, "mirror" if mode in ("mirror", "wrap", "constant", "nearest", "grid-constant") else mode)
    shape_of = output_shape if callable(output_shape) else lambda rows, cols: output_shape or (rows, cols)

    def taps(place):
        rows, cols, oy, ox = place  # of the source image, without padding
        height, width = shape_of(rows, cols)
        y, x = np.mgrid[oy : min(oy + side, height), ox : min(ox + side, width)].astype(float)
        at = coords(y, x, rows, cols)
        outside = np.zeros(y.shape, bool)
        if mode == "constant":
            for c, n in zip(at, (rows, cols)):
                outside |= (c < 0) | (c > n - 1)
        return [interpolate.axis_taps(np.asarray(c, float), n, order, mode, pad) for c, n in zip(at, (rows, cols))], outside

    def plan(rows_):
        for (image, rows, cols, _, _), _ in rows_:
            height, width = shape_of(rows - 2 * pad, cols - 2 * pad)
            for oy, ox in itertools.product(range(0, height, side), range(0, width, side)):
                yield image, rows, cols, oy, ox

    def needs(rows_):
        for (image, rows, cols, oy, ox), _ in rows_:
            ((_, ys), (_, xs)), outside = taps((rows - 2 * pad, cols - 2 * pad, oy, ox))
            used = []
            for a, b in itertools.product(ys, xs):
                ok = (a >= 0) & (b >= 0) & ~outside
                used.append((a[ok] // side) * (1 << 32) + b[ok] // side)
            found = np.unique(np.concatenate(used)).astype(np.int64).tolist()
            for at in found:
                yield image, rows, cols, (at >> 32) * side, (at & 0xFFFFFFFF) * side, oy, ox
            if not found:  # a tile of nothing but the constant: a place of its own that no source tile has
                yield image, rows, cols, -1 - oy, -1 - ox, oy, ox

    places = mapped(tiles.where("ty = 0 and tx = 0"), plan, _schema(tiles)).repartition(*KEY)
    wanted = mapped(places, needs, _schema(tiles, ("oy", T.IntegerType()), ("ox", T.IntegerType())))
    sent = wanted.join(tiles.select(*KEY, "shape", "img"), KEY, "left")

    def run(groups):
        for group in groups:
            (image, rows, cols, _, _), (oy, ox, *_) = group[0]
            rows, cols = rows - 2 * pad, cols - 2 * pad
            ((wy, ys), (wx, xs)), outside = taps((rows, cols, oy, ox))
            held, names = [], []
            for (_, _, _, ty, tx), (_, _, shape, v) in sorted(group, key=lambda r: r[0][3:]):
                if ty >= 0:
                    tile = np.zeros((side, side))
                    tile[: shape[0], : shape[1]] = v.reshape(tuple(shape))
                    held.append(tile)
                    names.append((ty // side << 32) + tx // side)
            out, names, stack = np.zeros(outside.shape), np.array(names, np.int64), np.array(held)
            for (a, p), (b, q) in itertools.product(zip(ys, wy), zip(xs, wx)):
                value = cval
                if len(names):
                    ok = (a >= 0) & (b >= 0) & ~outside
                    which = np.minimum(np.searchsorted(names, np.where(ok, (a // side << 32) + b // side, names[0])), len(names) - 1)
                    value = np.where(ok, stack[which, np.maximum(a, 0) % side, np.maximum(b, 0) % side], cval)
                out += p * q * value
            yield image, *shape_of(rows, cols), oy, ox, np.array(out.shape), np.where(outside, cval, out)

    return merged(sent, run, _schema(tiles, ("shape", INTS), ("img", DOUBLES)), "oy", "ox", "shape", "img", keys=["image_id", "oy", "ox"])


def padded(tiles: DataFrame, side: int, pad: int, mode: str, cval: float = 0.0) -> DataFrame:
    """Images with ``pad`` pixels of a boundary mode on every side."""
    return gather(tiles, side, lambda y, x, rows, cols: (y - pad, x - pad), lambda rows, cols: (rows + 2 * pad, cols + 2 * pad), 0, {"constant": "grid-constant"}.get(mode, mode), cval)


def affine_transform(tiles: DataFrame, side: int, matrix, offset=0.0, output_shape=None, order: int = 3, mode: str = "constant", cval: float = 0.0) -> DataFrame:
    m = np.asarray(matrix, float)
    if m.shape in ((3, 3), (2, 3)):
        m, offset = m[:2, :2], m[:2, 2]
    m = np.diag(m) if m.ndim == 1 else m
    o = np.broadcast_to(offset, 2)
    return gather(tiles, side, lambda y, x, rows, cols: (m[0, 0] * y + m[0, 1] * x + o[0], m[1, 0] * y + m[1, 1] * x + o[1]), output_shape, order, mode, cval)


def rotate(tiles: DataFrame, side: int, angle: float, reshape: bool = True, order: int = 3, mode: str = "constant", cval: float = 0.0) -> DataFrame:
    """Every image turned in its plane, in degrees, about its own centre."""
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    m = np.array([[c, s], [-s, c]])

    def size(rows, cols):
        corners = np.array([[0, 0, rows, rows], [0, cols, 0, cols]])
        return tuple((np.ptp(m @ corners, axis=1) + 0.5).astype(int).tolist()) if reshape else (rows, cols)

    def coords(y, x, rows, cols):
        oy, ox = (np.array([rows, cols]) - 1) / 2 - m @ ((np.array(size(rows, cols)) - 1) / 2)
        return m[0, 0] * y + m[0, 1] * x + oy, m[1, 0] * y + m[1, 1] * x + ox

    return gather(tiles, side, coords, size, order, mode, cval)


def warp(tiles: DataFrame, side: int, inverse_map, output_shape=None, order: int = 1, mode: str = "constant", cval: float = 0.0) -> DataFrame:
    """Gathers by an inverse map of (x, y) rows: a 3x3 matrix or a callable."""
    names = {"edge": "nearest", "symmetric": "reflect", "reflect": "mirror", "wrap": "grid-wrap"}

    def coords(y, x, rows, cols):
        points = np.stack([x.ravel(), y.ravel()], 1)
        if callable(inverse_map):
            src = inverse_map(points)
        else:
            h = np.c_[points, np.ones(len(points))] @ np.asarray(inverse_map, float).T
            src = h[:, :2] / h[:, 2:]
        return src[:, 1].reshape(y.shape), src[:, 0].reshape(x.shape)

    return gather(tiles, side, coords, output_shape, order, names.get(mode, mode), cval)


# Recursions along lines --------------------------------------------------------------------


def _recurse(x: np.ndarray, z: float, start: np.ndarray) -> np.ndarray:
    """c[k] = x[k] + z c[k-1] along the first axis, from the state ``start`` before it."""
    out = np.empty_like(x)
    for k in range(len(x)):
        start = out[k] = x[k] + z * start
    return out


def _starts(ends: list[np.ndarray], sizes: list[int], z: float, first: np.ndarray) -> list[np.ndarray]:
    """States before each tile of a line, from the tiles' own end states."""
    out = [first]
    for end, n in zip(ends[:-1], sizes):
        out.append(end + z**n * out[-1])
    return out


def spline_filter(tiles: DataFrame, side: int, order: int = 3, mode: str = "mirror") -> DataFrame:
    """B-spline coefficients of whole images kept as tiles, axis by axis and pole by pole.

    A tile runs the recursion from nothing and sends its end states, one number
    a line; along each line of tiles these are scanned to the states that the
    tiles start from (forwards, then backwards), and the tiles run again from
    those.  What moves is a few values per line and tile.
    """
    if order < 2:
        return tiles
    for axis in (0, 1):
        gain = 1.0
        poles = interpolate.POLES[order]
        for z in poles:
            gain *= (1 - z) * (1 - 1 / z)
        for k, z in enumerate(poles):
            tiles = _one_pole(tiles, side, axis, z, gain if k == 0 else 1.0, mode)
    return tiles


def _one_pole(tiles: DataFrame, side: int, axis: int, z: float, gain: float, mode: str) -> DataFrame:
    if mode not in ("mirror", "reflect", "grid-mirror", "grid-wrap"):
        raise ValueError(f"no spline filter for the mode {mode!r}")
    tiles = stage(tiles)
    along, across = ("ty", "tx") if axis == 0 else ("tx", "ty")
    lines = lambda v, h, w: np.ascontiguousarray(v.reshape(h, w) if axis == 0 else v.reshape(h, w).T) * gain
    fields = [("ahead", DOUBLES), ("sum", DOUBLES), ("back", DOUBLES), ("head", DOUBLES), ("tail", DOUBLES)]

    def ends(rows_):
        for place, (v,) in rows_:
            x = lines(v, *_size(place, side))
            n, zero = len(x), np.zeros(x.shape[1])
            c = _recurse(x, z, zero)
            back = _recurse(-z * c[::-1], z, zero)[-1]
            total = _recurse(x[::-1], z, zero)[-1]  # sum of z^k x[k]
            yield *place, c[-1], total, back, np.concatenate([x[0], x[-1]]), np.concatenate([c[-1], c[-2] if n > 1 else zero])

    def scan(groups):
        for got in groups:
            n = got[0][0][1 if axis == 0 else 2]
            at = [p[3 if axis == 0 else 4] for p, _ in got]
            sizes = [min(side, n - a) for a in at]
            ahead, sums, back, head, tail = ([d[j] for _, d in got] for j in range(5))
            w = len(ahead[0])
            if n == 1:
                first, states = np.zeros(w), [np.zeros(w)]
            else:
                zero = np.zeros(w)
                whole = _starts([*ahead, zero], [*sizes, 0], z, zero)[-1]  # sum of z^(n-1-k) x[k]
                plain = zero  # sum of z^k x[k]
                for s, size in zip(sums[::-1], sizes[::-1]):
                    plain = s + z**size * plain
                if mode == "mirror":
                    x0, xn = head[0][:w], head[-1][w:]
                    first = ((plain + z ** (n - 1) * (whole - z ** (n - 1) * x0 - xn)) / (1 - z ** (2 * n - 2)) - x0) / z
                elif mode == "grid-wrap":
                    first = whole / (1 - z**n)
                else:
                    first = (plain + z**n * whole) / (1 - z ** (2 * n))
                states = _starts(ahead, sizes, z, first)
            # A tile's recursion from the state s adds z^(k+1) s to its row k; run backwards that adds a multiple of s.
            echo = [-z * z * (1 - z ** (2 * size)) / (1 - z * z) for size in sizes]
            own = [b + e * s for b, e, s in zip(back, echo, states)]
            if n == 1:
                later = [np.zeros(w)]
            else:
                size = sizes[-1]
                last = tail[-1][:w] + z**size * states[-1]
                before = tail[-1][w:] + z ** (size - 1) * states[-1] if size > 1 else states[-1]
                if mode == "mirror":
                    end = z / (z * z - 1) * (last + z * before)
                    final = end / z + last
                elif mode == "grid-wrap":
                    loop = np.zeros(w)
                    for o, s in zip(own[::-1], sizes[::-1]):
                        loop = o + z**s * loop
                    final = loop / (1 - z**n)
                else:
                    final = z / (z - 1) * last / z + last
                later = _starts(own[::-1], sizes[::-1], z, final)[::-1]
            for (place, _), s, b in zip(got, states, later):
                yield *place, s, b

    def run(rows_):
        for place, (v, before, behind) in rows_:
            h, w = _size(place, side)
            x = lines(v, h, w)
            if place[1 + axis] > 1:
                c = _recurse(x, z, before)
                x = _recurse(-z * c[::-1], z, behind)[::-1]
            else:
                x = x / gain
            yield *place, np.array([h, w]), x if axis == 0 else x.T

    names = [f for f, _ in fields]
    sent = mapped(tiles, ends, _schema(tiles, *fields), "img")
    carried = merged(sent, scan, _schema(tiles, ("before", DOUBLES), ("behind", DOUBLES)), *names, keys=["image_id", across], order=[along])
    joined = tiles.select(*PLACE, "img").join(carried.select(*KEY, "before", "behind"), KEY)
    return mapped(joined, run, _schema(tiles, ("shape", INTS), ("img", DOUBLES)), "img", "before", "behind")
