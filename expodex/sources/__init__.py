"""Sources: page snapshots, saved search results, sitemaps, robots files, progress and blocklists."""
