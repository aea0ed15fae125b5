"""The declarative catalogs as rows: similarity definitions, computation strategies and operating points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.operators.splits import OPERATING_POINTS

# The ids of the similarity definitions, each with its kind, its input and the kernel that computes it.
DEFINITIONS = """
atomistic_soap_kernel_similarity | atomistic_kernel_similarity | precomputed_soap_kernel_or_distance | metric_to_similarity
biological_sequence_alignment_homology | sequence_alignment_similarity | sequence | alignment_identity
biomedical_text_semantic_similarity | text_embedding_similarity | embedding_columns_or_text_encoder | cosine
cell_morphology_profile_similarity | phenotypic_profile_similarity | morphology_feature_columns_or_embeddings | cosine
climate_niche_environmental_similarity | environmental_niche_overlap | climate_or_environment_feature_columns | mahalanobis
clinical_tabular_patient_similarity | tabular_covariate_similarity | clinical_covariate_columns | mahalanobis
clinical_temporal_site_domain | metadata_distance | site_or_time_or_domain | mixed_metadata
connectome_matrix_correlation_similarity | matrix_profile_similarity | connectivity_edge_columns | pearson
domain_distribution_mmd_similarity | distributional_similarity | domain feature_columns | domain_mmd
drug_target_ligand_target_composite | composite_similarity | ligand_similarity_csv target_similarity_csv | composite
drug_target_protein_sequence_go_integrated | composite_similarity | target_sequence_similarity_csv target_go_similarity_csv | composite
ehr_concept_relatedness_similarity | clinical_concept_similarity | clinical_concept_set | jaccard
environment_confounder_domain_similarity | causal_environment_similarity | environment_metadata | mixed_metadata
experimental_batch_protocol_similarity | metadata_or_distribution_similarity | batch_or_protocol_metadata | mixed_metadata
gdl_shift_factor_distance | distribution_shift_axis | shift_factor | mixed_metadata
gene_expression_signature_connectivity_similarity | ranked_signature_similarity | signature_vector_or_ranked_gene_list | pearson
genotype_ibd_ibs_similarity | genetic_relatedness_similarity | genotype_markers_or_precomputed_ibd_ibs | genotype_ibs
geospatial_haversine_region_distance | spatial_distance | lat lon | haversine
geospatial_location_embedding_similarity | embedding_similarity | location_embedding_columns | cosine
graph_neighborhood_jaccard_similarity | graph_topology_similarity | node_id edge_list | khop_jaccard
graph_wasserstein_wl_kernel_similarity | graph_kernel_similarity | precomputed_graph_kernel_or_distance | metric_to_similarity
hyperspectral_spectral_angle_similarity | spectral_signature_similarity | spectral_band_columns | spectral_angle
image_perceptual_embedding_similarity | image_embedding_similarity | image_embedding_columns_or_encoder | cosine
imaging_histogram_radiomics_similarity | image_feature_distribution_similarity | histogram_or_radiomics_feature_columns | jensen_shannon
interactome_network_proximity_similarity | network_set_proximity | entity_set network_edge_list | network_proximity
longitudinal_patient_trajectory_similarity | trajectory_alignment_similarity | event_sequence_or_time_series | event_alignment
mass_spectrometry_spectral_cosine_similarity | sparse_spectral_similarity | peak_list | spectrum_cosine
materials_composition_formula_similarity | feature_similarity | formula | formula_cosine
materials_structure_ofm_embedding_similarity | embedding_similarity | structure_feature_columns | cosine
medical_imaging_scanner_protocol_domain | metadata_similarity | scanner_or_site_metadata | mixed_metadata
microbiome_beta_diversity_similarity | community_composition_similarity | taxon_abundance_columns | bray_curtis
molecules_bemis_murcko_scaffold | metadata_group | scaffold | group_equality
molecules_butina_fingerprint_cluster | cluster_membership | cluster_id | group_equality
molecules_morgan_tanimoto | fingerprint_similarity | smiles | tanimoto
molecules_umap_cluster | cluster_membership | cluster_id | group_equality
multi_omics_similarity_network_fusion | multi_view_sample_similarity | omics_view_embeddings_or_precomputed_similarities | metric_to_similarity
nucleotide_contiguous_mutation_region | sequence_distance | sequence | sequence_identity
ontology_annotation_jaccard_similarity | ontology_similarity | ontology_term_set | jaccard
phylogenetic_patristic_distance_similarity | tree_distance_similarity | precomputed_tree_distance | metric_to_similarity
point_cloud_point_set_distance_similarity | point_cloud_distance_similarity | point_coordinates | chamfer
protein_binding_pocket_similarity | local_structure_similarity | pocket_structure_or_precomputed_pocket_similarity | metric_to_similarity
protein_mutational_regime_hamming | sequence_similarity | aligned_sequence | sequence_identity
protein_positional_mutation_coverage | set_similarity | mutated_position_set | jaccard
protein_structure_tm_score_similarity | structure_similarity | precomputed_structure_metric | metric_to_similarity
regulatory_dna_chromosome_holdout | metadata_group | chromosome | group_equality
regulatory_dna_embedding_cosine_variant_effect | embedding_distance | embedding | cosine
regulatory_dna_motif_bag_similarity | feature_similarity | motif_score_columns | cosine
rna_structural_component_similarity | group_similarity | sequence_cluster structural_component | group_equality
single_cell_covariate_transfer | metadata_group | covariate | group_equality
single_cell_logfc_cosine | response_similarity | logfc_feature_columns | cosine
spatial_prediction_horizon_similarity | spatial_distance_similarity | spatial_coordinates_or_precomputed_distance | haversine
survival_metric_learned_patient_similarity | learned_patient_metric_similarity | patient_covariates_or_precomputed_survival_metric | mahalanobis
time_series_dtw_shape_similarity | time_series_similarity | series | dtw
topological_persistence_diagram_similarity | topological_signature_distance | precomputed_persistence_distance_or_kernel | metric_to_similarity
"""

# The ids of the computation strategies with family and exactness, and the operator that runs them here ("-": none).
STRATEGIES = """
angular_random_projection_lsh | hashing_sketch_lsh | hybrid | hyperplane_candidates
binary_hamming_multi_index_hashing | binary_code_index | exact | hamming_radius
blocking_candidate_generation | blocking_filtering | hybrid | block_join
dense_embedding_hnsw_topk | approximate_nearest_neighbor | approximate | ivf_top_k
disk_backed_vector_ann_search | disk_backed_vector_index | approximate | ivf_top_k
distributed_partitioned_ann_search | distributed_similarity_search | approximate | ivf_top_k
dtw_lower_bound_pruning | metric_lower_bound_pruning | hybrid | dtw_pruned
exact_chunked_all_pairs | chunked_exact | exact | block_pairs
faiss_ivf_pq_compressed_topk | compressed_vector_index | approximate | pq_search
filtered_ann_attribute_constrained_search | filtered_ann | approximate | block_join
genomic_sketch_fracminhash_search | domain_specific_sketch | approximate | frac_minhash
gpu_accelerated_similarity_join | gpu_similarity_acceleration | hybrid | -
graph_kernel_random_feature_sketch | kernel_feature_sketch | approximate | wl_labels
hybrid_multimodal_similarity_index | hybrid_multimodal_index | hybrid | multimodal_search
kernel_approximation_feature_map | kernel_feature_sketch | approximate | random_fourier
learned_candidate_filter_similarity_join | learned_filter | approximate | learned_filter
lp_stable_lsh_distance | hashing_sketch_lsh | hybrid | projection_candidates
mass_spectrometry_sparse_cosine_acceleration | domain_specific_sparse_matrix | hybrid | sparse_cosine_pairs
maximum_inner_product_search_transform | maximum_inner_product_search | approximate | inner_product_transform
metric_tree_radius_knn | metric_tree_index | exact | pivot_candidates
minhash_lsh_jaccard_candidates | hashing_sketch_lsh | hybrid | minhash_jaccard
molecular_fingerprint_tanimoto_index | domain_specific_index | hybrid | prefix_jaccard
multi_vector_late_interaction_search | multi_vector_search | approximate | late_interaction
nn_descent_neighbor_graph | neighbor_graph_construction | approximate | neighbour_descent
pivot_permutation_metric_index | metric_space_index | hybrid | pivot_candidates
privacy_preserving_similarity_search | privacy_preserving_similarity | approximate | links_of_salted
semantic_ontology_similarity_join | semantic_ontology_join | hybrid | ancestor_sets
sequence_seed_prefilter_alignment_rerank | seed_extend_sequence_search | hybrid | seed_candidates
sinkhorn_wasserstein_histogram_search | optimal_transport_approximation | approximate | sinkhorn_similarity
sparse_inverted_index_topk | sparse_inverted_index | hybrid | sparse_products
streaming_similarity_join_sketch | streaming_similarity_join | approximate | stream_candidates
string_edit_similarity_join | similarity_join | hybrid | qgram_edit_join
structured_edit_distance_filter_verify | structured_edit_distance | hybrid | tree_edit_join
threshold_similarity_join_filter_verify | similarity_join | hybrid | prefix_jaccard
time_series_matrix_profile_index | time_series_index | hybrid | matrix_profile
trajectory_metric_index_filter_refine | metric_tree_index | exact | trajectory_join
two_stage_prefilter_rerank | generic_prefilter_rerank | hybrid | verify
weighted_minhash_generalized_jaccard | hashing_sketch_lsh | hybrid | weighted_minhash_candidates
"""

ENTRY = "id string, catalog string, kind string, exactness string, inputs array<string>, operator string, text string"


def _rows(text: str) -> list[list[str]]:
    return [[x.strip() for x in line.split("|")] for line in text.strip().splitlines()]


def entry_rows() -> list[tuple]:
    """All catalog entries as plain rows."""
    rows = [(i, "definition", kind, "exact", inputs.split(), kernel, " ".join((i, kind, inputs))) for i, kind, inputs, kernel in _rows(DEFINITIONS)]
    rows += [(i, "strategy", family, exactness, [], operator, " ".join((i, family, exactness))) for i, family, exactness, operator in _rows(STRATEGIES)]
    rows += [(i, "operating_point", unit, "exact", [unit], operator, " ".join((i, unit, region))) for i, (operator, unit, region) in OPERATING_POINTS.items()]
    # ids and their single words both can be searched for
    return [(*r[:-1], f"{r[-1]} {r[-1].replace('_', ' ')}") for r in rows]


def entries(spark: SparkSession) -> DataFrame:
    """All catalog entries: ``id, catalog, kind, exactness, inputs, operator, text``."""
    return spark.createDataFrame(entry_rows(), ENTRY)
