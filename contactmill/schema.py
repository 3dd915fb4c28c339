"""Column layouts of the tables that operators exchange."""

CONTACTS = "cell_id LONG, chrom1 STRING, pos1 LONG, chrom2 STRING, pos2 LONG, count DOUBLE"
PAIRS_LINE = "read_id STRING, chrom1 STRING, pos1 LONG, chrom2 STRING, pos2 LONG"
CELLS = "cell_id LONG, cell_name STRING, depth LONG, label STRING, batch STRING, metacell LONG"
CHROMS = "chrom_ord INT, chrom STRING, size_bp LONG"
PIXELS = "cell_id LONG, chrom_ord INT, bin1 LONG, bin2 LONG, value DOUBLE"
VIEWS = "view_id INT, cell_id LONG, features ARRAY<DOUBLE>"
CYTOBANDS = "chrom STRING, start LONG, end LONG, name STRING, type STRING"
SWEEP = "k INT, mean_purity DOUBLE, acc DOUBLE, global_score DOUBLE, wcos DOUBLE, hwis DOUBLE"
SIGNALS = "signal STRING, cell_id LONG, chrom STRING, bin LONG, value DOUBLE"
