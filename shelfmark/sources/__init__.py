"""Reading captures, inventories and batches; writing results."""
