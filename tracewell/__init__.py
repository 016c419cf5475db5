"""Document provenance on Spark: structure, fusion, segmentation, graphs, retention."""
