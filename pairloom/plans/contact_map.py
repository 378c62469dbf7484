"""The whole way from files to clusters."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import binning, clustering, contacts, graph, heatmap, normalise, order, pairs, report, sequences, tips
from pairloom.params import MapParams
from pairloom.session import materialise
from pairloom.sources import bam, bundle, fasta


@dataclass
class ContactMap:
    """A map with its contigs; ``seq_map`` is the symmetric map of contigs, ``tip_map`` and ``extent`` are there if asked for."""

    contigs: DataFrame
    seq_map: DataFrame
    accounting: DataFrame
    params: MapParams
    tip_map: DataFrame | None = None
    extent: DataFrame | None = None
    #: Processed maps by how they were made, and the last balancing's factors (ix, x).
    made: dict[tuple, DataFrame] = field(default_factory=dict, repr=False)
    scale: DataFrame | None = None
    #: Pixels that the last picture's side has beyond its last tick, which is cut to whole ones.
    reduced: int = 0

    @classmethod
    def from_frames(cls, refs: DataFrame, alignments: DataFrame, seqs: DataFrame, enzymes: list[str], params: MapParams) -> ContactMap:
        """``refs`` (refid, name, length), alignments as read from BAM or SAM, sequences as read from FASTA."""
        cutters = [sequences.enzyme(e) for e in enzymes]
        counted = sequences.with_sites(seqs.where(F.col("length") >= params.min_len), cutters, params.tip_size)
        contacts.check_unique(refs)
        dim = materialise(contacts.contig_dimension(refs, counted, params.min_len))
        kept = pairs.informative(alignments)
        # pairs are classified once and counted in several ways: written once, read by each count
        rows = materialise(pairs.classify(pairs.mate_pairs(kept, params), dim, params))
        tip_map = tips.symmetrize_tips(tips.count_tips(rows)) if params.tip_size else None
        seq_map = tips.marginal(tip_map) if tip_map is not None else contacts.symmetrize(contacts.count_contacts(rows))
        extent = binning.extent_map(rows, dim, params.bin_size) if params.bin_size else None
        return cls(dim, materialise(seq_map), pairs.accounting(rows), params, materialise(tip_map) if tip_map is not None else None, materialise(extent) if extent is not None else None)

    @classmethod
    def build(cls, spark: SparkSession, alignments: str, sequences_path: str, enzymes: list[str], params: MapParams | None = None) -> ContactMap:
        """From a BAM (or .sam) file sorted by name and a FASTA file."""
        params = params or MapParams()
        seqs = fasta.read_fasta(spark, sequences_path)
        if alignments.endswith(".sam"):
            refs = bam.sam_references(spark, alignments)
            return cls.from_frames(refs, bam.read_sam(spark, alignments, refs), seqs, enzymes, params)
        return cls.from_frames(bam.bam_references(spark, alignments), bam.read_bam(spark, alignments), seqs, enzymes, params)

    def save(self, path: str, clobber: bool = False) -> None:
        tables = {"contigs": self.contigs, "seq_map": self.seq_map, "accounting": self.accounting, "tip_map": self.tip_map, "extent": self.extent}
        bundle.save({k: v for k, v in tables.items() if v is not None}, asdict(self.params), path, clobber)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **thresholds: int) -> ContactMap:
        """A saved map; of the limits of length, signal and extent, those that are given hold and the others are reset to their defaults if any is."""
        tables, params = bundle.load(spark, path, ("contigs", "seq_map", "accounting"))
        own = MapParams(**params)
        given = {k: v for k, v in thresholds.items() if v}
        if given:
            own = replace(own, **({k: getattr(MapParams(), k) for k in ("min_len", "min_sig", "min_extent")} | given))
        extra = {}
        for name, wanted in (("tip_map", own.tip_size), ("extent", own.bin_size)):
            extra[name] = spark.read.parquet(f"{path}/{name}") if wanted else None
        return cls(params=own, **tables, **extra)

    def mask(self) -> DataFrame:
        return contacts.acceptance_mask(self.seq_map, self.contigs, self.params.min_len, self.params.min_sig)

    def register(self, prefix: str = "") -> None:
        """The tables as views for SQL."""
        for name, df in (("contigs", self.contigs), ("seq_map", self.seq_map), ("accounting", self.accounting), ("tip_map", self.tip_map), ("extent_map", self.extent)):
            if df is not None:
                df.createOrReplaceTempView(prefix + name)

    def processed(self, norm: bool = True, bisto: bool = True, flatten: bool = False, by: str = "sites", mean: str = "geometric", tol: float = 1e-6) -> DataFrame:
        """The map normalised (``by`` sites, or by the ``mean`` of lengths) and balanced, both over all contigs: masking comes later.

        Maps of ends are then marginalised, or flattened to ends numbered 2 ix + k.  A map is made once and kept in the shared folder.
        """
        key = (norm, bisto, flatten and self.tip_map is not None, by, mean, tol)
        if key in self.made:
            return self.made[key]
        if by not in ("sites", "length"):
            raise RuntimeError(f"{by} is nothing to normalise by: sites or length is")
        contacts.require_accepted(self.mask())
        m = self.seq_map if self.tip_map is None else self.tip_map
        if norm and self.tip_map is not None:
            m = tips.normalise_by_site(m, self.contigs) if by == "sites" else tips.normalise_by_length(m, self.contigs, self.params.tip_size)
        elif norm:
            m = normalise.by_sites(m, self.contigs) if by == "sites" else normalise.by_length(m, self.contigs, mean)
        if bisto:
            m = materialise(m)
            _, self.scale, _ = normalise.balance(m if self.tip_map is None else materialise(tips.marginal(m)), self.contigs, tol)
            m = normalise.scaled(m, self.scale)
        if self.tip_map is not None:
            m = tips.flatten(m) if flatten else tips.marginal(m)
        self.made[key] = materialise(m)
        return self.made[key]

    def subspace(self, processed: DataFrame, ordering: DataFrame | None = None, external: DataFrame | None = None, flatten: bool = False) -> DataFrame:
        """The accepted contigs' part, in an order (rank, ix, ori) if given; a flattened map is taken end by end."""
        mask = self.mask() if external is None else contacts.with_external_mask(self.mask(), external)
        if ordering is not None:
            kept = ordering.join(mask.where("accepted").select("ix"), "ix", "left_semi")
            return order.permute(processed, order.double_order(kept) if flatten else kept)
        if flatten:
            mask = mask.select(F.explode(F.array(2 * F.col("ix"), 2 * F.col("ix") + 1)).alias("ix"), "accepted")
        return contacts.compress(processed, mask)

    def extent_map(self, norm: bool = True, bisto: bool = False, ordering: DataFrame | None = None, mean: str = "geometric", tol: float = 1e-6) -> DataFrame:
        """The binned map of accepted contigs: normalised by length, without the masked, balanced, and then permuted."""
        bins = binning.extent_bins(self.contigs, self.params.bin_size)
        m = binning.symmetric_bins(self.extent)
        if norm:
            m = binning.normalise_extent(m, bins, self.contigs, mean)
        kept = binning.compressed_bins(bins, self.mask())
        m = binning.compress_extent(m, bins, self.mask())
        if bisto:
            square = materialise(m.select(F.col("b1").alias("i"), F.col("b2").alias("j"), "w"))
            m = normalise.balance(square, kept.select(F.col("dense_bin").alias("ix")), tol)[0].select(F.col("i").alias("b1"), F.col("j").alias("b2"), "w")
        if ordering is None:
            return m
        return binning.permute_extent(m, kept.select("ix", F.col("dense_bin").alias("bin_id"), "bin_no"), ordering)

    def edges(self, tol: float = 1e-6) -> DataFrame:
        """The graph of accepted contigs: normalised, balanced, scaled to the heaviest contact; nodes are contigs (ix)."""
        mask = self.mask()
        contacts.require_accepted(mask)
        kept = mask.where("accepted").select("ix")
        m = self.processed(tol=tol)
        inside = m.join(kept.withColumnRenamed("ix", "i"), "i", "left_semi").join(kept.withColumnRenamed("ix", "j"), "j", "left_semi")
        return graph.contact_edges(materialise(inside))

    def cluster(self, method: str = "infomap", seed: int = 1) -> tuple[DataFrame, DataFrame]:
        """(members, clusters), numbered and named by extent."""
        found = clustering.cluster_graph(self.edges(), method, seed).select(F.col("cl").alias("cl_id"), F.col("node").alias("ix"))
        return report.ranked(materialise(found), self.contigs)

    def tiles(self, members: DataFrame, clusters: DataFrame, max_image: int | None = None, simple: bool | None = None) -> tuple[DataFrame, DataFrame]:
        """Heatmap tiles of clusters in order, and the ticks of their borders, reduced to at most ``max_image`` a side.

        A map with bins shows its bins, normalised by length; ``simple``, or a map without, shows contigs, balanced and without the diagonal.
        """
        kept = report.filtered(clusters, self.params.min_extent)
        ordering = report.concatenated_order(kept, members)
        ordering = ordering.join(self.mask().where("accepted").select("ix"), "ix", "left_semi")
        if simple or self.params.bin_size is None:
            m, side = self.subspace(self.processed(), ordering), ordering.count()
            ticks = heatmap.cluster_ticks(kept)
        else:
            bins = binning.extent_bins(self.contigs, self.params.bin_size).join(ordering.select("ix"), "ix", "left_semi")
            m, side = self.extent_map(ordering=ordering).select(F.col("b1").alias("i"), F.col("b2").alias("j"), "w"), bins.count()
            sizes = bins.join(members, "ix").groupBy("cl_id").agg(F.count("*").alias("bins"))
            ticks = heatmap.cluster_ticks(kept.join(sizes, "cl_id"), "bins")
        bins_shown = not simple and self.params.bin_size is not None
        factor = heatmap.reduction(side, max_image or self.params.max_image)
        self.reduced = -(-side // factor) - side // factor
        if factor > 1:  # the picture is reduced before its logarithm is taken
            m = heatmap.downsample(m.where("i <> j") if not bins_shown else m, factor)
            ticks = ticks.withColumn("tick", F.floor(F.col("tick") / factor))
        return heatmap.log_tiles(m, zero_diagonal=not bins_shown and factor == 1, times=1.0 if bins_shown else 100.0), ticks
