"""Landing files, warehouse tables and synthetic rows."""
