"""Reading manifests and reports, writing results."""
