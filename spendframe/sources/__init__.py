"""Where rows come from: billing files, warehouse tables, the sample star schema."""
