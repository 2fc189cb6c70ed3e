"""Arrays, candidate lists, logs and reports as files."""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.sources.raw import BLOCKS, open_file


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, data): whole arrays of .npy files, in C order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            arrays = [np.load(io.BytesIO(x), allow_pickle=False) for x in b["content"]]
            yield pd.DataFrame({"path": b["path"], "shape": [list(a.shape) for a in arrays], "data": [np.ascontiguousarray(a).astype(float).ravel() for a in arrays]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, shape array<long>, data array<double>")


def write_files(rows: DataFrame, folder: str) -> None:
    """One file per row (name, content), in a folder that all executors share; written under another name first, so tasks may be repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for b in batches:
            for r in b.itertuples():
                part = f"{root}/.{r.name.replace('/', '-')}.{TaskContext.get().taskAttemptId()}"
                if "/" in r.name:
                    fs.create_dir(f"{root}/{r.name.rpartition('/')[0]}")
                with fs.open_output_stream(part) as out:
                    out.write(r.content)
                fs.move(part, f"{root}/{r.name}")
            yield pd.DataFrame({"n": [len(b)]})

    rows.select("name", "content").mapInPandas(run, "n long").count()


def write_array(cells: DataFrame, order: list[str], path: str, shape: tuple[int, ...] | None, by_columns: bool = False, each: int = 1 << 20) -> None:
    """Values (order, x), dense and unique, in order as one file of 32-bit floats, with an array's header if it has a shape.

    Tasks write ranges of the order beside the file; these are joined to it in
    streams, so the whole never is in one place but on disk.
    """
    fs, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    job = f"{root.rsplit('/', 1)[0]}/.array-{uuid.uuid4().hex}"
    fs.create_dir(job)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, _ = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        part, n = f"{job}/{task.partitionId():08d}.{task.taskAttemptId()}", 0
        with fs.open_output_stream(part) as out:
            for b in batches:
                out.write(b["x"].to_numpy().astype("<f4").tobytes())
                n += len(b)
        yield pd.DataFrame({"part": [task.partitionId()], "at": [part], "n": [n]})

    parts = max(1, cells.count() // each + 1)
    done = sorted(map(tuple, cells.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("x").mapInPandas(run, "part long, at string, n long").collect()))  # a row for each task
    head = b""
    if shape is not None:
        if sum(n for _, _, n in done) != int(np.prod(shape)):
            raise ValueError(f"not as many values as {shape} has")
        buffer = io.BytesIO()
        np.lib.format.write_array_header_1_0(buffer, {"descr": "<f4", "fortran_order": by_columns, "shape": tuple(int(x) for x in shape)})
        head = buffer.getvalue()
    with fs.open_output_stream(f"{job}/whole") as out:
        out.write(head)
        for _, at, _ in done:
            with fs.open_input_stream(at) as part:
                while piece := part.read(1 << 22):
                    out.write(piece)
    fs.move(f"{job}/whole", root)
    fs.delete_dir(job)


def write_npy(rows: DataFrame, folder: str) -> None:
    """One .npy file per row (name, shape, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                buffer = io.BytesIO()
                np.save(buffer, np.asarray(r.data, np.float32).reshape(tuple(r.shape)))
                out.append(buffer.getvalue())
            yield pd.DataFrame({"name": b["name"] + ".npy", "content": out})

    write_files(rows.select("name", "shape", "data").mapInPandas(run, "name string, content binary"), folder)


def is_image_shape(rows: int, cols: int) -> bool:
    """Both sides powers of two of at least 4."""
    return all(n >= 4 and n & (n - 1) == 0 for n in (rows, cols))


def read_image_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """(r, c, x) of XX.npy with the shape, band and delays that lie beside it."""
    part = {r.path.rsplit("/", 1)[1]: r.data for r in read_npy(spark, f"{folder}/*.npy").where("path not like '%/XX.npy'").collect()}
    rows, cols = (int(x) for x in part["iarrShape.npy"])
    if not is_image_shape(rows, cols):
        raise ValueError("both sides must be powers of two of at least 4")
    image = read_npy(spark, f"{folder}/XX.npy").select(F.posexplode("data").alias("i", "x")).select((F.col("i") / cols).cast("long").alias("r"), (F.col("i") % cols).cast("long").alias("c"), "x")
    return image, {"rows": rows, "cols": cols, "max_dt": int(part["imaxDT.npy"][0]), "f_min": part["fmin_max.npy"][0], "f_max": part["fmin_max.npy"][1]}


def read_image_bundles(spark: SparkSession, root: str) -> DataFrame:
    """(bundle, r, c, x, max_dt, f_min, f_max) of all image bundles, a folder each; a side that is no power of two of at least 4 is an error."""
    name = lambda i: F.regexp_extract("path", "([^/]+)/([^/]+)[.]npy$", i)
    parts = read_npy(spark, f"{root}/*/*.npy").select(name(1).alias("bundle"), name(2).alias("name"), "data")
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("data")))
    heads = parts.where("name <> 'XX'").groupBy("bundle").agg(of("iarrShape").alias("sides"), of("imaxDT")[0].cast("long").alias("max_dt"), of("fmin_max")[0].alias("f_min"), of("fmin_max")[1].alias("f_max"))
    good = F.forall("sides", lambda n: (n >= 4) & (F.bit_count(n.cast("long")) == 1))
    sides = F.when(good, F.col("sides")).otherwise(F.raise_error(F.lit("both sides must be powers of two of at least 4")))
    cells = parts.where("name = 'XX'").join(heads.withColumn("sides", sides), "bundle").select("bundle", "max_dt", "f_min", "f_max", F.col("sides")[1].cast("long").alias("cols"), F.posexplode("data").alias("i", "x"))
    return cells.select("bundle", F.floor(F.col("i") / F.col("cols")).cast("long").alias("r"), (F.col("i") % F.col("cols")).alias("c"), "x", "max_dt", "f_min", "f_max")


def read_packed_header(raw: bytes) -> dict:
    """Two 32-bit whole numbers and four floats."""
    return dict(zip(("samples", "n_p", "d_max", "f_min", "f_max", "sigma"), struct.unpack("<iiffff", raw[:24]), strict=True))


def read_packed_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples, n_p, d_max, f_min, f_max, sigma) of files that begin with a packed header, each read in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"path": p} | read_packed_header(bytes(x)) for p, x in zip(b["path"], b["content"], strict=True)])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, samples int, n_p int, d_max double, f_min double, f_max double, sigma double")


def read_floats(spark: SparkSession, path: str) -> DataFrame:
    """(i, x) of a dump of 32-bit floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["content"]:
                v = np.frombuffer(x, "<f4").astype(float)
                yield pd.DataFrame({"i": np.arange(len(v)), "x": v})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "i long, x double")


def candidate_lines(lines: DataFrame) -> DataFrame:
    """(mt, mdt, mwidth, msnr) of whitespace-separated snr, sample, seconds, width, delay, measure, beam; other rows are left out."""
    p = F.split(F.trim("value"), "\\s+")
    cols = {"mt": (1, "long"), "mdt": (4, "long"), "mwidth": (3, "long"), "msnr": (0, "double")}
    return lines.select(*[F.try_element_at(p, F.lit(i + 1)).try_cast(t).alias(n) for n, (i, t) in cols.items()]).dropna()


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return candidate_lines(spark.read.text(path))


def _padded(c: Column, width: int = 10) -> Column:
    return F.lpad(c.cast("string"), width, " ")


def delegate_line(t0: float, dt: float) -> Column:
    """A delegate's fixed-width log line; its size is its own cluster's."""
    seconds = F.lit(t0) + F.col("mt") * F.lit(dt)
    return F.concat(_padded(F.col("n")), _padded(F.col("mt")), F.lpad(F.format_string("%.6f", seconds), 10, " "), _padded(F.col("mdt")), _padded(F.col("mwidth")), F.lpad(F.format_string("%.6f", F.col("msnr")), 10, " "), _padded(F.col("num")))


def candidate_line(t0: float, dt: float) -> Column:
    """As a delegate's line, but without a size, for candidates that are no clusters."""
    seconds = F.lit(t0) + F.col("mt") * F.lit(dt)
    return F.concat(_padded(F.col("n")), _padded(F.col("mt")), F.lpad(F.format_string("%.6f", seconds), 10, " "), _padded(F.col("mdt")), _padded(F.col("mwidth")), F.lpad(F.format_string("%.6f", F.col("msnr")), 10, " "))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (line) as text files in a folder."""
    lines.select("line").write.mode("overwrite").text(path)


def run_log(path: str, project: str, chunk: int, found: list[int], seconds: int, measures: list[float] | None = None) -> list[str]:
    """Lines of a run's log, whose wording is a fixed format; found: numbers of the chunks with detections, and with measures the dispersion of each."""
    out = [f"Pass to Data File: {path}", f"Project Name: {project}", f"Length of Chunk: {chunk}", f"Quant of Successful Chunks: {len(found)}", f"Numbers of Successful Chunks: [{', '.join(map(str, found))}]"]
    if measures is not None:
        out.append(f"Successfull coherentD Array: [{', '.join(f'{m:g}' for m in measures)}]")
    return [*out, f"Running Time (seconds): {seconds}"]


def run_log_lines(runs: DataFrame) -> DataFrame:
    """(run, at, line): logs of many runs (run, path, project, chunk, found, seconds), as run_log() words them."""
    listed = F.concat(F.lit("["), F.array_join(F.col("found").cast("array<string>"), ", "), F.lit("]"))
    named = [("Pass to Data File", F.col("path")), ("Project Name", F.col("project")), ("Length of Chunk", F.col("chunk").cast("string")), ("Quant of Successful Chunks", F.size("found").cast("string")), ("Numbers of Successful Chunks", listed), ("Running Time (seconds)", F.col("seconds").cast("string"))]
    return runs.select("run", F.posexplode(F.array(*[F.concat(F.lit(f"{n}: "), v) for n, v in named])).alias("at", "line"))


def candidates_by_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, n): rows of each candidate file but for its first line, which is its header."""
    return spark.read.text(path).groupBy(F.input_file_name().alias("path")).agg((F.count("*") - 1).alias("n"))


def count_candidates(spark: SparkSession, path: str) -> int:
    """Lines of candidate files but for each file's first, which is its header."""
    lines = spark.read.text(path).select(F.input_file_name().alias("f"))
    return lines.count() - lines.distinct().count()


def csv_line() -> Column:
    return F.concat_ws(",", "mt", "mdt", "mwidth", F.format_string("%.6f", F.col("msnr")))


#: A report line's names, in order.
REPORT = ["Block", "Chunk", "Rows", "Cols", "SucRow", "SucCol", "SNR", "CohDisp", "windWidth"]


def report_line() -> Column:
    """Block and chunk count from 1 in the line."""
    parts = [F.format_string("Block=  %d,Chunk=  %d,Rows=  %d,Cols=  %d", F.col("block") + 1, F.col("chunk") + 1, F.col("rows"), F.col("cols"))]
    parts.append(F.format_string(", SucRow=  %d,SucCol=  %d, SNR=  %.4f, CohDisp=  %.4f, windWidth=  %d", "suc_row", "suc_col", "snr", "coh_disp", "wind_width"))
    return F.concat(*parts)


def parse_report(lines: DataFrame) -> DataFrame:
    """The columns of report lines back."""
    get = lambda name: F.regexp_extract("value", f"{name}=\\s*(-?[0-9.]+)", 1)
    names = ["block", "chunk", "rows", "cols", "suc_row", "suc_col", "snr", "coh_disp", "wind_width"]
    out = {n: get(k).cast("double" if n in ("snr", "coh_disp") else "long") for n, k in zip(names, REPORT, strict=True)}
    out["block"], out["chunk"] = out["block"] - 1, out["chunk"] - 1
    return lines.select(*[c.alias(n) for n, c in out.items()])


def log_values(lines: DataFrame, prefix: str, keep: list[str] | None = None) -> DataFrame:
    """(keep, values): numbers of a run log's lines that begin so, as an array."""
    rest = F.split(F.trim(F.expr(f"substring(value, {len(prefix) + 1})")), "[\\s,;\\[\\]]+")
    return lines.where(F.col("value").startswith(prefix)).select(*(keep or []), F.filter(F.transform(rest, lambda x: x.try_cast("double")), lambda x: x.isNotNull()).alias("values"))


def sidecar_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path and the header's fields) of many JSON headers, as read_sidecar_header() has them."""
    h = spark.read.schema("tstart double, nsamp long, fcen double, bwchan double, tsamp double, nsub long, unit string").json(path)
    scale = F.when(F.col("unit") == "Hz", 1e-6).otherwise(1.0)
    bw = F.col("bwchan") * scale
    fields = {"nbits": F.lit(8), "npol": F.lit(4), "nchan": F.col("nsub").cast("int"), "chan_bw": bw, "cent_freq": F.col("fcen") * scale, "obs_bw": F.col("nsub") * bw, "block_size": F.col("nsamp") * 4 * F.col("nsub"), "t_resolution": F.col("tsamp"), "tstart": F.col("tstart")}
    return h.select(F.input_file_name().alias("path"), *[c.alias(n) for n, c in fields.items()])


def read_sidecar_header(text: str) -> dict:
    """Header of a four-file recording from JSON: Hz become MHz; 8 bits and four planes."""
    h = json.loads(text)
    scale = 1e-6 if h.get("unit", "MHz") == "Hz" else 1.0
    nchan, bw = int(h["nsub"]), float(h["bwchan"]) * scale
    return {"nbits": 8, "npol": 4, "nchan": nchan, "chan_bw": bw, "cent_freq": float(h["fcen"]) * scale, "obs_bw": nchan * bw, "block_size": int(h["nsamp"]) * 4 * nchan, "t_resolution": float(h["tsamp"]), "tstart": float(h["tstart"])}


def sibling_planes(path: str) -> list[str]:
    """The four files of a recording, from the first one's path: the part S0 of its name counts up."""
    head, found, tail = path.rpartition("_S0_")
    if not found:
        raise ValueError("the first file's name has no part _S0_")
    return [f"{head}_S{i}_{tail}" for i in range(4)]


def plane_block(spark: SparkSession, first: str, header: dict) -> DataFrame:
    """BLOCKS of a four-file recording: its one block, whose four files move on together."""
    h, paths = header, sibling_planes(first)
    samples = h["block_size"] // (h["npol"] * h["nchan"] * h["nbits"] // 8)
    for p in paths:
        with open_file(p) as f:
            if f.size() < samples * h["nchan"]:
                raise ValueError(f"{p} is cut short")
    row = (first.rsplit("/", 1)[-1], paths, "planes", 0, 0, 0, samples, h["npol"], h["nbits"], h["nchan"], False, h["chan_bw"], h["cent_freq"], h["obs_bw"], h["t_resolution"], "OTHER")
    return spark.createDataFrame([row], BLOCKS)


def plane_shift(chunk_bytes: int, npol: int = 4) -> int:
    """Bytes by which each of the parallel files moves on for a chunk of so many bytes in all."""
    return chunk_bytes // npol


def read_planes(spark: SparkSession, paths: list[str], nchan: int, each: int = 1 << 22) -> DataFrame:
    """(plane, chan, isamp, v) of parallel files of 8-bit samples that interleave channels, read in ranges of about so many bytes."""
    step = max(1, each // nchan) * nchan
    ranges = []
    for plane, path in enumerate(paths):
        with open_file(path) as f:
            ranges += [(plane, path, at, min(step, f.size() - at)) for at in range(0, f.size(), step)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                with open_file(r.path) as f:
                    v = np.frombuffer(f.read_at(r.size, r.first), np.int8).astype(float)
                i = np.arange(r.first, r.first + len(v))
                yield pd.DataFrame({"plane": r.plane, "chan": i % nchan, "isamp": i // nchan, "v": v})

    table = spark.createDataFrame(ranges, "plane int, path string, first long, size long").repartition(max(1, len(ranges)))
    return table.mapInPandas(run, "plane int, chan long, isamp long, v double")


def plane_samples(planes: DataFrame) -> DataFrame:
    """(chan, pol, isamp, re, im): even planes are real parts, odd ones imaginary parts of their polarisation."""
    part = F.col("plane") % 2
    return planes.groupBy("chan", F.floor(F.col("plane") / 2).cast("int").alias("pol"), "isamp").agg(F.sum(F.when(part == 0, F.col("v")).otherwise(0.0)).alias("re"), F.sum(F.when(part == 1, F.col("v")).otherwise(0.0)).alias("im"))
