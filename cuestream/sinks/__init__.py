"""Writers: subtitle formats as ordered line rows, timed JSON, project bundles."""
