"""siteflow: Spark jobs for intensity cubes (sites x an ordered axis) and their trajectory clusters."""
