"""Readers on generated, seeded trajectories, whole, cut and broken, and writers read back."""

import bz2
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.sources import lines as L
from framelake.sources import sinks as W
from framelake.sources import trajectories as R

KINDS = ["Na", "Cl", "O"]


class Run:
    """A random trajectory in an orthogonal box, of a few kinds of atoms."""

    def __init__(self, seed, frames=5, atoms=7):
        rng = np.random.default_rng(seed)
        self.box = np.round(rng.uniform(8, 14, 3), 3)
        self.kind = np.sort(rng.integers(0, len(KINDS), atoms))
        self.f = np.round((rng.random((1, atoms, 3)) + rng.normal(0, 0.02, (frames, atoms, 3)).cumsum(axis=0)) % 1, 6)
        self.v, self.force = np.round(rng.normal(size=(frames, atoms, 3)), 5), np.round(rng.normal(size=(frames, atoms, 3)), 5)
        self.step, self.rng = np.cumsum(rng.integers(1, 9, frames)), rng

    def triples(self, v):
        return "\n".join(" ".join(map(repr, map(float, r))) for r in v)

    def dump(self):
        out = []
        for k, step in enumerate(self.step):
            order = self.rng.permutation(len(self.kind))
            rows = [" ".join(map(str, [i + 1, self.kind[i] + 1, *map(float, self.f[k, i]), *map(float, self.v[k, i]), *map(float, self.force[k, i])])) for i in order]
            bounds = "\n".join(f"0.0 {b}" for b in map(float, self.box))
            out.append(f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n{len(order)}\nITEM: BOX BOUNDS pp pp pp\n{bounds}\nITEM: ATOMS id type xsu ysu zsu vx vy vz fx fy fz\n" + "\n".join(rows) + "\n")
        return "".join(out)

    def cell(self):
        return [[float(b) if i == j else 0.0 for j in range(3)] for i, b in enumerate(self.box)]

    def names(self):
        found = sorted(set(self.kind))
        return " ".join(KINDS[k] for k in found), " ".join(str((self.kind == k).sum()) for k in found)

    def xdatcar(self):
        names, counts = self.names()
        head = f"run\n 1.0\n{self.triples(self.cell())}\n {names}\n {counts}\n"
        return head + "".join(f"Direct configuration= {k + 1:5d}\n{self.triples(f)}\n" for k, f in enumerate(self.f))

    def calculation(self, k, velocities=False):
        v = lambda name, rows: f'<varray name="{name}">' + "".join(f"<v>{' '.join(map(repr, map(float, r)))}</v>\n" for r in rows) + "</varray>"
        own = v("velocities", self.v[k]) if velocities else ""
        return f'<calculation>\n<structure><crystal>{v("basis", self.cell())}</crystal>{v("positions", self.f[k])}{own}</structure>\n{v("forces", self.force[k])}<energy><i name="e_fr_energy">{-k}.5</i></energy>\n</calculation>\n'

    def vasprun(self, velocities=False):
        atoms = "".join(f"<rc><c>{KINDS[k]} </c><c>  {k + 1}</c></rc>" for k in self.kind)
        kinds = "".join(f"<rc><c>1</c><c>{n}</c><c>{10.5 + k}</c><c>1.0</c><c>p</c></rc>" for k, n in enumerate(KINDS))
        head = f'<modeling><incar><i name="POTIM">  1.5</i></incar><atominfo><array name="atoms" ><set>{atoms}</set></array><array name="atomtypes"><set>{kinds}</set></array></atominfo>\n'
        return head, [self.calculation(k, velocities) for k in range(len(self.f))], "</modeling>\n"

    def contcar(self, k, velocities=True):
        names, counts = self.names()
        text = f"run\n1.0\n{self.triples(self.cell())}\n{names}\n{counts}\nDirect\n{self.triples(self.f[k])}\n"
        return text + (f"\n{self.triples(self.v[k])}\n" if velocities else "")

    def xyz(self, k):
        cell = " ".join(map(str, np.array(self.cell()).ravel()))
        rows = [f"{KINDS[e]} {' '.join(map(repr, map(float, p)))} {' '.join(map(repr, map(float, q)))}" for e, p, q in zip(self.kind, self.f[k] * self.box, self.force[k])]
        return f'{len(rows)}\nLattice="{cell}" Properties=species:S:1:pos:R:3:forces:R:3 note="of run {k}" step={self.step[k]}\n' + "\n".join(rows) + "\n"


@pytest.fixture(autouse=True)
def small_splits(spark):
    """Splits of a few hundred bytes, so that records cross them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_have_their_numbers_and_offsets(spark, tmp_path):
    rng = np.random.default_rng(1)
    text = "".join("é" * int(n) + "\n" for n in rng.integers(0, 40, 200))
    (tmp_path / "a").write_text(text)
    (tmp_path / "b").write_text("one\ntwo")
    rows = L.numbered_lines(spark, str(tmp_path)).collect()
    a = sorted((r.no, r.offset, r.value) for r in rows if r.file.endswith("a"))
    assert len({r.split for r in rows if r.file.endswith("a")}) > 3
    at, want = 0, []
    for k, line in enumerate(text.split("\n")[:-1]):
        want.append((k, at, line))
        at += len(line.encode()) + 1
    assert a == want and sorted((r.no, r.value) for r in rows if r.file.endswith("b")) == [(0, "one"), (1, "two")]
    heads = L.records(L.line_before(L.numbered_lines(spark, str(tmp_path / "a")), F.col("value") == "", "after"), F.length("value") > 20).orderBy("no").collect()
    count, before = -1, False
    for r, (_, _, line) in zip(heads, want):
        count += len(line) > 20
        assert (r.record, r.after) == (count, before)
        before = line == ""


@pytest.mark.parametrize("pack", [None, "gz", "bz2"])
def test_dump(spark, tmp_path, pack):
    run = Run(2)
    path = tmp_path / ("t.dump" + (f".{pack}" if pack else ""))
    path.write_bytes({"gz": gzip.compress, "bz2": bz2.compress, None: bytes}[pack](run.dump().encode()))
    frames = R.read_dump(spark, str(path))
    assert [(r.frame, r.step, r.lx, r.n_atoms) for r in frames.orderBy("frame").collect()] == [(k, s, run.box[0], 7) for k, s in enumerate(run.step)]
    atoms = R.dump_atoms(frames).orderBy("frame", "atom").collect()
    assert [(r.frame, r.id, r.type, r.fx, r.vy, r.force_z) for r in atoms] == [(k, i + 1, run.kind[i] + 1, run.f[k, i, 0], run.v[k, i, 1], run.force[k, i, 2]) for k in range(5) for i in range(7)]
    assert sorted(r.step for r in R.read_dump(spark, str(path), start=1, stride=2).collect()) == run.step[1::2].tolist()


def test_cut_and_broken_dumps(spark, tmp_path):
    text = Run(3).dump()
    for k, end in enumerate((len(text) - 4, len(text) - 60, text.rindex("ITEM: ATOMS") + 5, text.rindex("ITEM: TIMESTEP") + 16)):
        path = tmp_path / f"cut{k}"
        path.write_text(text[:end])
        frames = R.read_dump(spark, str(path)).collect()
        # a number cut within its digits still is one
        assert len(frames) in ((4, 5) if k == 0 else (4,))
    lines = text.split("\n")
    (tmp_path / "broken").write_text("\n".join(lines[:10] + lines[11:]))
    with pytest.raises(Exception, match="another number of atoms"):
        R.read_dump(spark, str(tmp_path / "broken")).collect()


def test_thermo(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k * 10, *np.round(rng.normal(300, 9, 2), 3).tolist()) for k in range(60)]
    text = "units metal\n12 atoms\n" + "".join("Step Temp PotEng\n" + "".join(f"  {' '.join(map(str, r))}\n" for r in part) + "Loop time of 1.0\nWARNING: 3 of 4\n" for part in (rows[:25], rows[25:]))
    (tmp_path / "log").write_text(text)
    got = sorted((r.step, r.thermo["Temp"], r.thermo["PotEng"]) for r in R.read_thermo(spark, str(tmp_path / "log")).collect())
    assert got == rows


def test_xdatcar_whole_and_cut(spark, tmp_path):
    run = Run(5)
    (tmp_path / "whole").write_text(run.xdatcar())
    (tmp_path / "cut").write_text(run.xdatcar()[:-30])
    rows = R.read_xdatcar(spark, str(tmp_path)).orderBy("frame", "atom").collect()
    for name, n in (("whole", 5), ("cut", 4)):
        own = [r for r in rows if r.file.endswith(name)]
        assert [(r.frame, r.element, r.fx, r.fz) for r in own] == [(k, KINDS[run.kind[i]], run.f[k, i, 0], run.f[k, i, 2]) for k in range(n) for i in range(7)]
        assert own[0].cell[::4] == run.box.tolist()


@pytest.mark.parametrize("own", [True, False])
def test_vasprun_atoms(spark, tmp_path, own):
    run = Run(6)
    head, parts, tail = run.vasprun(own)
    (tmp_path / "vasprun.xml").write_text(head + "".join(parts) + tail)
    rows = R.vasprun_atoms(spark, str(tmp_path)).orderBy("frame", "atom").collect()
    assert [(r.frame, r.element, r.mass, r.fx, r.force_y) for r in rows] == [(k, KINDS[run.kind[i]], 10.5 + run.kind[i], run.f[k, i, 0], run.force[k, i, 1]) for k in range(5) for i in range(7)]
    assert [r.t for r in rows[::7]] == pytest.approx([0.0015 * k for k in range(5)])
    if own:
        assert [r.vz for r in rows] == run.v[:, :, 2].ravel().tolist()
    else:
        d = np.diff(run.f, axis=0)
        u = np.concatenate([run.f[:1], run.f[0] + np.cumsum(d - np.rint(d), axis=0)])
        assert [r.vx for r in rows] == pytest.approx(np.gradient(u[:, :, 0], 0.0015, axis=0, edge_order=2).ravel().tolist())
        assert all(r.vx is None for r in R.vasprun_atoms(spark, str(tmp_path), reconstruct=False).collect())
    energies = R.frame_energies(R.read_vasprun(spark, str(tmp_path))).orderBy("frame").collect()
    assert [(r.name, r.energy) for r in energies] == [("e_fr_energy", -k - 0.5 if k else 0.5) for k in range(5)]


def test_interrupted_and_malformed_vasprun(spark, tmp_path):
    head, parts, tail = Run(7).vasprun()
    texts = {
        "whole": head + "".join(parts) + tail, "record": head + "".join(parts)[:-200], "file": head + "".join(parts), "middle": head + parts[0] + parts[1].replace("</structure>", "</structur>") + "".join(parts[2:]) + tail,
        "open": head + parts[0] + parts[1][:-40] + "".join(parts[2:]) + tail, "head": head[:60],
    }
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "vasprun.xml").write_text(text)
    states = {r.file.split("/")[-2]: (r.frames, r.malformed, r.interruption) for r in R.vasprun_states(spark, str(tmp_path / "*")).collect()}
    assert states == {"whole": (5, 0, "none"), "record": (4, 0, "in_record"), "file": (5, 0, "in_file"), "middle": (4, 1, "none"), "open": (4, 1, "none"), "head": (0, 0, "in_file")}
    assert sorted(r.frame for r in R.read_vasprun(spark, str(tmp_path / "record")).collect()) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="malformed"):
        R.read_vasprun(spark, str(tmp_path / "middle")).collect()
    assert sorted(r.frame for r in R.read_vasprun(spark, str(tmp_path / "middle"), strict=False).collect()) == [0, 2, 3, 4]


RULES = [
    ("IBRION = 0 ; NSW = 100 ! steps\nMDALGO = 3\nISIF = 3\nLANGEVIN_GAMMA = 10 10\n", ("molecular_dynamics", "npt", "langevin", "parrinello_rahman", "first_principles")),
    ("IBRION = 0\nNSW = 5\nMDALGO = 3\nISIF = 3\nLANGEVIN_GAMMA = 0.0 0.0\n", ("molecular_dynamics", "nph", "none", "parrinello_rahman", "first_principles")),
    ("IBRION=0;NSW=5;SMASS=-3;ML_LMLFF=T;ML_MODE=run", ("molecular_dynamics", "nve", "none", "none", "model")),
    ("IBRION=0;NSW=5;MDALGO=2;SMASS=0.5;ML_LMLFF=T", ("molecular_dynamics", "nvt", "nose_hoover", "none", "mixed")),
    ("IBRION=0;NSW=5;MDALGO=1;ANDERSEN_PROB=0.0", ("molecular_dynamics", "nve", "none", "none", "first_principles")),
    ("IBRION=0;NSW=5;SMASS=-2", ("molecular_dynamics", "constant_velocity", "none", "none", "first_principles")),
    ("IBRION=0;NSW=5;SMASS=-1", ("molecular_dynamics", "unresolved", "rescaling", "none", "first_principles")),
    ("IBRION=2\n", ("static", "static", "static", "static", "first_principles")), ("NSW=4\n", ("unresolved", "unresolved", "unresolved", "unresolved", "first_principles")),
]


def test_controls(spark, tmp_path):
    for k, (text, _) in enumerate(RULES):
        (tmp_path / f"f{k}").write_text(text)
    got = {int(r.file[-1]): (r.dynamics, r.ensemble, r.thermostat, r.barostat, r.forces) for r in R.certify_controls(R.read_controls(spark, str(tmp_path))).collect()}
    assert got == {k: want for k, (_, want) in enumerate(RULES)}


def test_extxyz_round_trip(spark, tmp_path):
    frames = spark.createDataFrame(
        [(k, [10.0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0], ["O", "H"], [[0.25 * k, 0.0, 0.0], [1.0, 2.0, 3.0]], [[0.5, 0.0, 0.0], [0.0, 0.0, -1.0]]) for k in range(5)],
        "frame bigint, lattice array<double>, species array<string>, positions array<array<double>>, forces array<array<double>>",
    )
    W.write_extxyz(frames, str(tmp_path / "out"))
    rows = R.read_extxyz(spark, str(tmp_path / "out" / "*.txt")).collect()
    got = sorted((int(r.info["frame"]), r.species, r.positions, r.forces, r.lattice) for r in rows)
    assert got == [(r.frame, r.species, r.positions, r.forces, r.lattice) for r in frames.orderBy("frame").collect()]
    with pytest.raises(Exception):
        W.write_extxyz(frames, str(tmp_path / "out"))


def test_extxyz_index_seeks_and_checks(spark, tmp_path):
    run, folder = Run(8, frames=9), tmp_path / "xyz"
    folder.mkdir()
    texts = [run.xyz(k) for k in range(9)]
    (folder / "a.xyz").write_text("".join(texts))
    index = W.write_xyz_index(spark, str(folder))
    rows = index.orderBy("frame").collect()
    assert [(r.frame, r.offset, r.length, r.sha256) for r in rows] == [(k, sum(map(len, texts[:k])), len(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(texts)]
    wanted = index.filter("frame in (2, 7)").select("file", "frame")
    got = {r.frame: r for r in R.fetch_frames(index, wanted).collect()}
    for k in (2, 7):
        assert got[k].info["note"] == f"of run {k}" and got[k].forces == run.force[k].tolist() and got[k].species == [KINDS[e] for e in run.kind]
        assert np.allclose(got[k].positions, run.f[k] * run.box, rtol=0, atol=1e-12)
    (folder / "a.xyz").write_text("".join(texts).replace("of run 7", "of run 0"))
    with pytest.raises(Exception, match="isn't what its index says"):
        R.fetch_frames(index, wanted).collect()


def test_growing_file_is_polled_by_whole_frames(spark, tmp_path):
    run, path = Run(9, frames=6), tmp_path / "g.xyz"
    text, seen, got = "".join(run.xyz(k) for k in range(6)), None, []
    for upto in (2 * len(text) // 5, 2 * len(text) // 5 + 3, 3 * len(text) // 4, len(text)):
        path.write_text(text[:upto])
        fresh, now = R.poll_frames(spark, str(path), seen)
        got.append(sorted(int(r.info["step"]) for r in fresh.collect()))
        seen = spark.createDataFrame(now.collect(), now.schema)
    assert sum(got, []) == run.step.tolist() and got[1] == [] and all(got[k] for k in (0, 2, 3))


def test_broken_extxyz(spark, tmp_path):
    run = Run(10)
    whole = [run.xyz(k) for k in range(3)]
    (tmp_path / "cut").write_text("".join(whole)[:-90])
    assert sorted(r.frame for r in R.read_extxyz(spark, str(tmp_path / "cut")).collect()) == [0, 1]
    for k, text in enumerate((whole[0].rsplit("\n", 2)[0] + "\n" + whole[1], whole[0] + "extra 1 2 3 4 5 6\n" + whole[1], whole[0].replace("R:3:forces:R:3", "R:3:forces:R:2"))):
        (tmp_path / f"bad{k}").write_text(text)
        with pytest.raises(Exception, match="number of atoms|fit Properties"):
            R.read_extxyz(spark, str(tmp_path / f"bad{k}")).collect()


def test_contcar_streams(spark, tmp_path):
    run = Run(11)
    (tmp_path / "s").write_text("".join(run.contcar(k) for k in range(5))[:-25])
    rows = R.contcar_atoms(R.read_contcar_stream(spark, str(tmp_path / "s")), 2.0).orderBy("frame", "atom").collect()
    assert [(r.frame, r.element, r.fx, r.vz) for r in rows] == [(k, KINDS[run.kind[i]], run.f[k, i, 0], run.v[k, i, 2]) for k in range(4) for i in range(7)]
    assert [r.t for r in rows[::7]] == pytest.approx([0.002 * k for k in range(4)])
    (tmp_path / "n").write_text(run.contcar(0, False) + run.contcar(1))
    with pytest.raises(Exception, match="isn't whole"):
        R.read_contcar_stream(spark, str(tmp_path / "n")).collect()
    assert R.read_contcar_stream(spark, str(tmp_path / "n"), velocities=False).count() == 2


def test_single_structures(spark, tmp_path):
    run = Run(12)
    text = run.contcar(0, False).replace("Direct", "Selective dynamics\nCartesian")
    lines = text.split("\n")
    at = lines.index("Cartesian") + 1
    lines[at : at + 7] = [" ".join(map(repr, map(float, v))) + " T T T" for v in run.f[0] * run.box]
    (tmp_path / "POSCAR").write_text("\n".join(lines))
    (tmp_path / "CONTCAR.gz").write_bytes(gzip.compress(run.contcar(1).encode()))
    rows = {r.file.rsplit("/", 1)[1]: r for r in R.read_poscar(spark, str(tmp_path)).collect()}
    assert np.allclose(rows["POSCAR"].fractions, run.f[0]) and rows["POSCAR"].velocities is None
    assert rows["CONTCAR.gz"].velocities == run.v[1].tolist() and rows["CONTCAR.gz"].cell[::4] == run.box.tolist()
    with pytest.raises(R.FormatError):
        list(R.poscar_frames("a\nb\nc\nd\ne\nf\ng\nh\ni\n"))


def test_table_sink_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    W.write_table(df, str(tmp_path / "t"), ["k"])
    files = R.manifest(spark, str(tmp_path / "t"), "*.csv").collect()
    assert len(files) == 1
    assert open(files[0].path.removeprefix("file:")).read() == "k,v\n1,a\n2,b\n"
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, digest string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, digest string")
    assert {(r.path, r.change) for r in R.changed_files(before, after).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_cache_knows_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, k, float(k) if k % 4 else None) for k in range(40)], "run_id int, atom bigint, x double")
    path = str(tmp_path / "cache")
    W.write_cache(rows, path)
    assert sorted(r.atom for r in W.read_cache(spark, path, runs=["1"]).collect()) == list(range(1, 40, 3))
    assert W.read_cache(spark, path).count() == 40
    spark.createDataFrame([(99, 1.0)], "atom bigint, x double").write.mode("append").parquet(f"{path}/run_id=2")
    with pytest.raises(W.CacheError, match="2"):
        W.read_cache(spark, path)
    assert W.read_cache(spark, path, runs=["0", "1"]).count() == 27
