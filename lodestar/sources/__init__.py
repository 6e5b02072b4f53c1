"""Where rows come from and where they go: tables, source trees, snapshots, reports."""
